"""Admission by sliding window and by token bucket, for batches of recorded events.

The state depends on what was admitted before, so no window frame can say it; each key is one sequential pass over its
time-ordered events. A key's events arrive as sorted runs of a partition and are consumed one by one, so memory holds
one window of one key, however many events it has.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _scan(events: DataFrame, key: str, stamp: str, ident: str, step, extra: str) -> DataFrame:
    rows = events.select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(stamp).cast("timestamp")).alias("us"), F.col(ident).cast("long").alias("i"))
    ordered = rows.where("us is not null").repartition("k").sortWithinPartitions("k", "us", "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, state = object(), None
        for batch in batches:
            out = []
            for k, us in zip(batch["k"], batch["us"]):
                if k != key_now:
                    key_now, state = k, None
                state, value = step(state, us / 1e6)
                out.append(value)
            yield batch.assign(v=out)[["i", "k", "v"]]

    return ordered.mapInPandas(run, f"i long, k string, v {extra}")


def sliding_window(events: DataFrame, key: str, stamp: str, ident: str, rate: int = 60, window_s: float = 60.0) -> DataFrame:
    """(ident, key, accepted): at most `rate` accepted events within any (t - window, t]; rejected ones don't count."""

    def step(state, t):
        state = deque() if state is None else state
        while state and state[0] <= t - window_s:
            state.popleft()
        if len(state) >= rate:
            return state, False
        state.append(t)
        return state, True

    out = _scan(events, key, stamp, ident, step, "boolean")
    return out.select(F.col("i").alias(ident), F.col("k").alias(key), F.col("v").alias("accepted"))


def token_bucket(events: DataFrame, key: str, stamp: str, ident: str, rps: float = 1.0, burst: int = 3) -> DataFrame:
    """(ident, key, wait_s): how long each request waits; a wait empties the bucket and moves its clock on."""

    def step(state, t):
        tokens, last = (float(burst), t) if state is None else state
        tokens = min(float(burst), tokens + (t - last) * rps)  # below zero while earlier ones still wait
        if tokens < 1.0:
            wait = (1.0 - tokens) / rps
            return (0.0, t + wait), wait
        return (tokens - 1.0, t), 0.0

    out = _scan(events, key, stamp, ident, step, "double")
    return out.select(F.col("i").alias(ident), F.col("k").alias(key), F.col("v").alias("wait_s"))
