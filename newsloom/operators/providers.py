"""Text models behind a protocol: completion with fallback, embedding in batches. Whoever runs a job brings the model.

Providers run inside Arrow batches on the executors and must be picklable; none is part of this library.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMBED_BATCH, RETRIES = 32, 3


@runtime_checkable
class TextProvider(Protocol):
    def complete(self, prompt: str) -> str | None: ...


@runtime_checkable
class Embedder(Protocol):
    def embed_batch(self, texts: list[str]) -> list[list[float] | None]: ...


class Busy(Exception):
    """A provider asks to be called again, after `wait` seconds where it says so."""

    def __init__(self, wait: float | None = None):
        super().__init__("busy")
        self.wait = wait


def attempt(call: Callable, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep):
    """The call's result; repeated while the provider is busy, waiting 1, 2, 4 ... seconds or as told; null on any other failure."""
    for k in range(retries + 1):
        try:
            return call()
        except Busy as e:
            if k == retries:
                return None
            sleep(2.0**k if e.wait is None else e.wait)
        except Exception:  # noqa: BLE001 - a failed call is a null, never a failed job
            return None
    return None


def completed(rows: DataFrame, key: str, prompt: str, providers: list[TextProvider]) -> DataFrame:
    """(key, response, provider) of every row: the first provider, in order, that answers; null where none does or the prompt is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["p"]:
                answer, at = None, None
                for n, provider in enumerate(providers if isinstance(text, str) else []):
                    answer = attempt(lambda p=provider: p.complete(text))
                    if answer is not None:
                        at = n
                        break
                out.append((answer, at))
            yield pd.DataFrame({"k": batch["k"], "response": [a for a, _ in out], "provider": pd.array([n for _, n in out], dtype="Int32")})

    kind = rows.schema[key].dataType.simpleString()
    got = rows.select(F.col(f"`{key}`").alias("k"), F.col(f"`{prompt}`").alias("p")).mapInPandas(run, f"k {kind}, response string, provider int")
    return got.withColumnRenamed("k", key)


def embedded(rows: DataFrame, key: str, text: str, embedder: Embedder, fallback: Embedder | None = None) -> DataFrame:
    """(key, vector) of every row, L2-normalised, in calls of EMBED_BATCH texts; null for blank texts and where the call failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.strip() if isinstance(t, str) else "" for t in batch["t"]]
            there = [k for k, t in enumerate(texts) if t]
            vectors: list[list[float] | None] = [None] * len(texts)
            for begin in range(0, len(there), EMBED_BATCH):
                part = there[begin : begin + EMBED_BATCH]
                got = attempt(lambda: embedder.embed_batch([texts[k] for k in part]))
                if got is None and fallback is not None:
                    got = attempt(lambda: fallback.embed_batch([texts[k] for k in part]))
                for k, v in zip(part, got or []):
                    x = np.asarray(v if v is not None else [], np.float64)
                    n = np.sqrt((x * x).sum())
                    vectors[k] = (x / n).tolist() if n > 0 and np.isfinite(n) else None
            yield pd.DataFrame({"k": batch["k"], "vector": vectors})

    kind = rows.schema[key].dataType.simpleString()
    got = rows.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInPandas(run, f"k {kind}, vector array<float>")
    return got.withColumnRenamed("k", key)


def summaries(responses: DataFrame, key: str, response: str) -> DataFrame:
    """(key, failed, tldr, bullets) out of recorded model responses.

    Failed: no JSON object, an empty tldr or one that says there is too little content, or no bullet left."""
    x = F.from_json(F.col(f"`{response}`"), "tldr string, bullets array<string>")
    tldr = F.trim(F.coalesce(x["tldr"], F.lit("")))
    bullets = F.transform(F.filter(F.coalesce(x["bullets"], F.array().cast("array<string>")), lambda b: F.coalesce(b, F.lit("")) != ""), lambda b: F.trim(b))
    failed = (tldr == "") | F.contains(tldr, F.lit("Insufficient content")) | (F.size(bullets) == 0)
    return responses.select(F.col(f"`{key}`").alias(key), F.coalesce(failed, F.lit(True)).alias("failed"), F.when(~failed, tldr).alias("tldr"), F.when(~failed, bullets).alias("bullets"))
