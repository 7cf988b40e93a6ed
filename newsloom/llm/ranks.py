"""Global ranks and running totals within groups, without putting a hot group into one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 250_000


def buckets_for(rows: int) -> int:
    """How many buckets keep each near ROWS_PER_BUCKET rows."""
    return max(16, -(-rows // ROWS_PER_BUCKET))


def hash_bucket(hashed: Column, buckets: int) -> Column:
    """Bucket of a 64-bit hash by its leading bits; rows are numbered by bucket and then by hash."""
    return F.floor((F.shiftrightunsigned(hashed, 33).cast("double")) * buckets / 2.0**31).cast("int")


def running(df: DataFrame, keys: list[str], bucket: str, order: list, out: str, value: str | None = None) -> DataFrame:
    """`df` with `out`: rows (or the sum of `value`) before this row within `keys`, in the order (bucket, *order).

    Each (keys, bucket) is numbered by itself; the totals of earlier buckets, one row for each (keys, bucket), are
    added. `df` is read twice and should be cheap to read again.
    """
    each = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumn("__local", F.sum(each).over(inner) - each)
    totals = df.groupBy(*keys, bucket).agg(F.sum(each).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(*keys, bucket, (F.sum("__n").over(before) - F.col("__n")).alias("__before"))
    return local.join(offsets, [*keys, bucket]).withColumn(out, F.col("__local") + F.col("__before")).drop("__local", "__before")


def sieve(ids: DataFrame, column: str, most_bits: int = 1 << 24):
    """A function that keeps the rows of a frame whose long column may be among `ids` (or, with
    inside=False, are surely not), by a bitmap of bounded size.

    The bitmap has about 16 bits for each id, at most `most_bits`; beyond that more rows than wanted are kept, and none
    is ever lost. It spares the shuffle of rows that a join would drop.
    """
    n = ids.count()
    bits = 1 << 16
    while bits < min(16 * n, most_bits):
        bits *= 2
    slot = F.pmod(F.xxhash64(column), F.lit(bits))
    words = ids.select((slot / 64).cast("int").alias("w"), F.expr("1L").alias("one"), F.pmod(slot, F.lit(64)).cast("int").alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("b"))).alias("m"))
    table = np.zeros(bits // 64, np.int64)
    for r in words.collect():  # at most bits / 64 rows
        table[r["w"]] = r["m"]
    shared = ids.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(T.BooleanType())
    def may(slots: pd.Series) -> pd.Series:
        s = slots.to_numpy()
        return pd.Series((shared.value[s // 64] >> (s % 64) & 1) == 1)

    def keep(df: DataFrame, name: str, inside: bool = True) -> DataFrame:
        return df.where(may(F.pmod(F.xxhash64(name), F.lit(bits))) == inside)

    return keep
