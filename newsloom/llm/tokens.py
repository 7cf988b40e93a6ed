"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = os.environ.get("NEWSLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the public split pattern these vocabularies were made with.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding(Path(path).name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each text as a bigint; null for null, 0 for an empty text."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        own = encoding(vocabulary)
        return texts.map(lambda t: len(own.encode_ordinary(t)), na_action="ignore").astype("Int64")

    return count(text)
