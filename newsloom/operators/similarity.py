"""Near-duplicate flags of a batch of vectors against a window of the latest ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, THRESHOLD, MOST = 100, 0.85, 10_000


def latest_window(vectors: DataFrame, order: list, size: int = WINDOW) -> DataFrame:
    """The newest `size` rows (id, vector): a top-k, so its size is bounded."""
    return vectors.orderBy(*order).limit(size)


def _units(vectors: list, dims: int) -> np.ndarray:
    """Unit vectors; zero for those that are null, hold nulls, have another length or no direction."""
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        if v is not None and len(v) == dims:
            x = np.asarray(v, np.float64)
            n = np.sqrt((x * x).sum())
            if np.isfinite(n) and n > 0:
                out[k] = x / n
    return out


def window_duplicates(batch: DataFrame, window: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, nearest, similarity, is_duplicate) for every row of `batch` (id, vector) against `window` (id, vector).

    The window is a bounded top-k, at most MOST rows (more are refused); it is one matrix that goes along, and every
    Arrow batch is one matrix product with it. Of equal similarities the smallest id of the window counts. Zero vectors
    and those of another length are similar to nothing; null vectors and an empty window give a null `nearest`.
    """
    rows = window.where("vector is not null").select("id", "vector").orderBy("id").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a window of more than {MOST} vectors")
    dims = max((len(r["vector"]) for r in rows), default=0)
    names, known = np.array([r["id"] for r in rows], np.int64), _units([r["vector"] for r in rows], dims)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            there = part["vector"].notna().to_numpy() & bool(len(names))
            sims = np.round(_units(list(part["vector"]), dims) @ known.T, 6) if len(names) else np.zeros((len(part), 1))
            at = sims.argmax(1)
            best = np.where(there, sims[np.arange(len(part)), at] + 0.0, 0.0)
            nearest = pd.array(names[at] if len(names) else np.zeros(len(part), np.int64), dtype="Int64")
            nearest[~there] = pd.NA
            yield pd.DataFrame({"id": part["id"], "nearest": nearest, "similarity": best, "is_duplicate": there & (best >= threshold)})

    return batch.select(F.col("id").cast("long").alias("id"), "vector").mapInPandas(run, "id long, nearest long, similarity double, is_duplicate boolean")


def embed_text(title, summary):
    """What an article is embedded by: title and summary joined by a space, trimmed; null as empty."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))


def result_counters(flags: DataFrame) -> DataFrame:
    """(unique, duplicates, failed) of flags: failed are rows without a usable vector (null `is_duplicate`)."""
    return flags.agg(F.count_if(F.col("is_duplicate") == False).alias("unique"), F.count_if("is_duplicate").alias("duplicates"), F.count_if(F.col("is_duplicate").isNull()).alias("failed"))  # noqa: E712
