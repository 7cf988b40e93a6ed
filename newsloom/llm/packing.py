"""Fill fixed-capacity containers with whole items by harmonic classes (problem 8).

Sizes are put into classes whose upper bounds are reciprocals of the capacity (C/1, C/2, C/3 ...); the wide classes of
few items are cut further, so that an item is at most STEP below its class's bound. A container is filled by a
recipe: a fixed count of items of each class whose bounds together fit the capacity. The recipes are made from the
class counts alone, a histogram of a few hundred numbers whatever the number of items; items then find their container
from their rank within their class, independently across workers. So no item ever looks at another, and waste is
bounded by the distance of items to their class bounds and one unfinished container for each recipe.

An item larger than the capacity is split into pieces of the full capacity, each a container of its own, and one last
piece that is packed like an item. Items that are null or of size 0 go into no container (container_id null). Repeated
rows are separate items. Extra columns are dropped; only `key` is kept.
"""

from __future__ import annotations

import bisect
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.ranks import buckets_for, hash_bucket, running
from newsloom.session import cut

STEP = 0.015


@lru_cache(maxsize=64)
def class_bounds(capacity: int, step: float = STEP) -> tuple[int, ...]:
    """Ascending upper bounds of the classes: every C // k, and steps between those that lie far apart."""
    bounds = {capacity // k for k in range(1, capacity + 1)}
    ordered = sorted(bounds)
    for low, high in zip([0, *ordered], ordered):
        x = float(high)
        while low and x * (1 - step) > low + 1:
            x *= 1 - step
            bounds.add(int(x))
    return tuple(sorted(bounds))


def recipes(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(containers, {class bound: items in each})] that use up `counts` {class bound: items}.

    Largest class first; the rest of a container takes as many as fit of each next smaller class. A recipe is repeated
    until one of its classes can't fill it once more, so there are about as many recipes as classes.
    """
    left = {b: n for b, n in counts.items() if n}
    out = []
    while left:
        room, one = capacity, {}
        for bound in sorted(left, reverse=True):
            if (n := min(room // bound, left[bound])) > 0:
                one[bound] = n
                room -= n * bound
        times = min(left[b] // n for b, n in one.items())
        out.append((times, one))
        for b, n in one.items():
            left[b] -= n * times
            if not left[b]:
                del left[b]
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, first_token, size, container_id) for every item, or every piece of an item over `capacity`."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sizes = items.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("__size"))
    full = F.floor((F.col("__size") - 1) / capacity).cast("long")
    pieces = sizes.where("__size > 0").select(
        key, "__size", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("__size") <= capacity, F.lit(0).cast("long")).otherwise(full))).alias("piece_no")
    )
    bounds = class_bounds(capacity)

    @F.pandas_udf(T.LongType())
    def bound_of(s: pd.Series) -> pd.Series:
        return s.map(lambda v: bounds[bisect.bisect_left(bounds, v)])

    first = F.col("piece_no") * capacity
    pieces = pieces.select(key, "piece_no", first.alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("__size") - first).alias("size"))
    pieces = cut(pieces.withColumn("bound", bound_of("size")))
    counts = {r["bound"]: r["n"] for r in pieces.groupBy("bound").agg(F.count("*").alias("n")).collect()}  # one row for each class
    plan = recipes(counts, capacity)

    # For each class: the first rank that each recipe takes, its items a container, and its first container.
    shelf: dict[int, tuple[list[int], list[int], list[int]]] = {b: ([], [], []) for b in counts}
    taken, container = dict.fromkeys(counts, 0), 0
    for times, one in plan:
        for b, n in one.items():
            for column, v in zip(shelf[b], (taken[b], n, container)):
                column.append(v)
            taken[b] += n * times
        container += times

    @F.pandas_udf(T.LongType())
    def container_of(bound: pd.Series, rank: pd.Series) -> pd.Series:
        def find(b: int, r: int) -> int:
            starts, each, containers = shelf[b]
            k = bisect.bisect_right(starts, r) - 1
            return containers[k] + (r - starts[k]) // each[k]

        return pd.Series([find(b, r) for b, r in zip(bound, rank)], dtype="int64")

    hashed = pieces.withColumn("__h", F.xxhash64(key, "piece_no"))
    hashed = hashed.withColumn("__b", hash_bucket(F.col("__h"), buckets_for(sum(counts.values()))))
    ranked = running(hashed, ["bound"], "__b", ["__h", key, "piece_no", "size"], "__rank")
    packed = ranked.select(key, "piece_no", "first_token", "size", container_of("bound", "__rank").alias("container_id"))
    nothing = sizes.where("__size <= 0").select(
        key, F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("container_id")
    )
    return packed.unionByName(nothing)


def split_items(packed: DataFrame, key: str) -> DataFrame:
    """(key) of the items that the packing put into several containers because they exceed one."""
    of = packed.where("container_id is not null").groupBy(key, "piece_no").agg(F.min("container_id").alias("first"), F.max("container_id").alias("last"))
    whole = of.groupBy(key).agg(F.max("piece_no").alias("piece_no"), F.min("first").alias("first"), F.max("last").alias("last"))
    return whole.where("piece_no > 0 and first <> last").select(key)
