"""The k most similar vectors of every vector by shifted space-filling curves (problem 7).

Vectors are projected to a few dimensions (principal axes of a bounded sample of SAMPLE vectors, turned at random for
each curve), shifted, and put on a Hilbert curve; the place on the curve, with a few bits of the key's hash below it, is
the sort key. Each curve is cut into ranges of RANGE stretches by quantiles of the places of all vectors; a range also
gets the stretch beyond each of its ends, so that a window never ends at a range's bound. In a range, every vector is compared with all vectors of its
own stretch of HALF neighbours and of the two stretches beside it, as one matrix product. The curves differ in rotation
and shift, so neighbours that one curve parts are met on another. The best k of every curve are merged.

A fixed window sees a share of all vectors that falls as 1/n, so the number of curves grows with n (`curves_for`):
CURVES up to n = SEEN * HALF, then as the power GROWTH of n. Each vector is compared with curves * 3 * HALF others. The
curves are done CURVES at a time, each group reduced to the best k before the next, so that the rows shuffled at once
don't grow faster than n. Vectors travel as
16-bit fixed-point numbers of their unit length, which changes a cosine by a few millionths. Equal vectors get
different places by their key's hash, so a hot group is spread over several ranges, and within a range over as many stretches as it fills.

Texts that aren't a JSON list of `dims` finite numbers, and all-zero lists, take no part. A vector is never its own
neighbour; repeated rows of one key count once. With fewer than k others, as many as there are come out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.ranks import sieve
from newsloom.session import cut

SAMPLE = 4096
CURVES = 5
HALF = 2048
RANGE = 8  # stretches in a range
TIES = 5  # bits of the key's hash below a place
QUERIES = 10_000  # of a search by brute force that are held at once
SEEN = 20  # stretches to which CURVES curves are enough
GROWTH = 0.6  # of the number of curves beyond, so that recall of far neighbours stays about level
AXES = 24
TURNED = 8
BITS = 6
SEED = 20240229


def parse_vector(text: str | None, dims: int) -> np.ndarray | None:
    """A unit vector, or null where the text isn't a list of `dims` finite numbers, not all zero."""
    if not isinstance(text, str):
        return None
    try:
        values = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(values, list) or len(values) != dims or any(type(v) is not float and type(v) is not int for v in values):
        return None
    try:
        x = np.array(values, np.float64)
    except OverflowError:
        return None
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max() if dims else 0.0
    if top == 0:
        return None
    x /= top
    return x / np.sqrt((x * x).sum())


def pack(x: np.ndarray) -> tuple[bytes, float]:
    """Fixed-point form of a unit vector: 16-bit numbers and their step."""
    step = float(np.abs(x).max() / 32767)
    return np.rint(x / step).astype("<i2").tobytes(), step


def unpack(packed: list[bytes], steps: np.ndarray) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), "<i2").reshape(len(packed), -1).astype(np.float32) * np.asarray(steps, np.float32)[:, None]
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (n, dims), each coordinate below 2 ** bits.

    Gray-code transform on the coordinates in place, from the highest bit down, then the bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q = 1 << bit
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        t ^= np.where(x[n - 1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= t
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> bit & 1)
    return out


class Curves:
    """Projections fitted to a sample, and the keys they give."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        centred = sample - self.mean
        _, vectors = np.linalg.eigh(centred.T @ centred)
        axes = min(AXES, sample.shape[1])
        basis = vectors[:, ::-1][:, :axes]
        turned = min(TURNED, axes)
        self.maps = []
        for _ in range(curves):
            q, _ = np.linalg.qr(rng.normal(size=(axes, axes)))
            m = basis @ q[:, :turned]
            p = centred @ m
            low, high = np.percentile(p, 0.5, axis=0), np.percentile(p, 99.5, axis=0)
            width = np.maximum(high - low, 1e-9) * 1.25
            self.maps.append((m, low - rng.uniform(0, 0.2, turned) * width, width))

    def keys(self, x: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """(n, curves) places of the vectors on each curve, or on those from `first` to before `last`."""
        out = []
        for m, low, width in self.maps[first:last]:
            cells = np.clip(((x - self.mean) @ m - low) / width * 2**BITS, 0, 2**BITS - 1)
            out.append(hilbert(cells.astype(np.int64), BITS))
        return np.stack(out, 1)


def curves_for(n: int, half: int = HALF) -> int:
    """Curves that n vectors need in stretches of `half`."""
    return max(CURVES, math.ceil(CURVES * (n / (SEEN * half)) ** GROWTH))


def _sample(rows: DataFrame, dims: int) -> np.ndarray:
    keys = rows.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(SAMPLE)
    texts = rows.join(F.broadcast(keys), "key").orderBy("key", "text").limit(SAMPLE).collect()
    parsed = [v for v in (parse_vector(r["text"], dims) for r in texts) if v is not None]
    return np.array(parsed) if parsed else np.eye(2, dims)


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).where("key is not null and text is not null")


def prepared(df: DataFrame, key: str, text: str, dims: int) -> DataFrame:
    """(key, packed, step) of every usable vector, checkpointed."""
    rows = _rows(df, key, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 2000):
                part = batch.iloc[begin : begin + 2000]
                parsed = [parse_vector(t, dims) for t in part["text"]]
                good = [k for k, v in enumerate(parsed) if v is not None]
                if not good:
                    continue
                packed, steps = zip(*(pack(parsed[k]) for k in good))
                yield pd.DataFrame({"key": part["key"].to_numpy()[good], "packed": packed, "step": np.array(steps, np.float32)})

    vectors = cut(rows.mapInPandas(run, "key long, packed binary, step float"))
    repeated = vectors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key"))
    if repeated.isEmpty():
        return vectors
    maybe = sieve(repeated, "key")  # few rows, so that only they are shuffled
    return maybe(vectors, "key", False).unionByName(maybe(vectors, "key").dropDuplicates(["key"]))


def _cuts(places: DataFrame, n: int, half: int) -> dict[int, np.ndarray]:
    """{curve: (ranges - 1, 3) places}: the bounds between the ranges of every curve, and the places about a stretch
    before and behind each, by quantiles over all vectors (half a dozen numbers for each RANGE * `half` vectors)."""
    ranges = max(1, -(-n // (RANGE * half)))
    if ranges == 1:
        return {}
    beside = 1.05 * half / n  # a little more than a stretch, as quantiles are approximate
    probs = [min(1.0, max(0.0, k / ranges + d)) for k in range(1, ranges) for d in (-beside, 0.0, beside)]
    found = places.groupBy("curve").agg(F.percentile_approx("place", probs, max(10_000, int(20 * n / half))).alias("q"))
    return {r["curve"]: np.array(r["q"], np.int64).reshape(-1, 3) for r in found.collect()}


def _slots(spark, count: int) -> np.ndarray:
    """`count` numbers that Spark's hash partitioning puts into `count` different partitions."""
    found: dict[int, int] = {}
    begin, step = 0, 32 * count
    while len(found) < count:
        rows = spark.range(begin, begin + step).groupBy(F.pmod(F.hash("id"), F.lit(count)).alias("p")).agg(F.min("id").alias("id")).collect()  # at most `count`
        for r in rows:
            found.setdefault(r["p"], r["id"])
        begin += step
    return np.array([found[p] for p in range(count)], np.int64)


def _ordered(vectors: DataFrame, curves: Curves, first: int, last: int, n: int, half: int) -> DataFrame:
    """(curve, range, own, key, packed, step) of every vector on the curves from `first` to before `last`, in the order of
    each range; own: false for the vectors that a range has from its neighbours."""

    def places(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        ties = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TIES)
        return curves.keys(x, first, last) << TIES | ties.astype(np.int64)[:, None]

    def only_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at = places(unpack(list(batch["packed"]), batch["step"].to_numpy()).astype(np.float64), batch["key"].to_numpy())
                yield pd.DataFrame({"curve": np.tile(np.arange(at.shape[1], dtype=np.int32), len(at)), "place": at.ravel()})

    cuts = _cuts(vectors.mapInPandas(only_places, "curve int, place long"), n, half) if n > RANGE * half else {}
    ranges = 1 + len(next(iter(cuts.values()), ()))
    slots = _slots(vectors.sparkSession, (last - first) * ranges)  # each range is a partition of its own

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            at = places(unpack(list(batch["packed"]), batch["step"].to_numpy()).astype(np.float64), batch["key"].to_numpy())
            for curve in range(at.shape[1]):
                place, bounds = at[:, curve], cuts.get(curve, np.zeros((0, 3), np.int64))
                own = np.searchsorted(bounds[:, 1], place, side="right")
                low = np.searchsorted(bounds[:, 2], place, side="right")  # the first range that still wants it
                high = np.searchsorted(bounds[:, 0], place, side="right")
                for away in range(-2, 3):
                    to = own + away
                    keep = np.flatnonzero((to >= low) & (to <= high)) if away else np.arange(len(place))
                    if len(keep):
                        yield batch.iloc[keep].assign(curve=np.int32(curve), range=to[keep].astype(np.int32), own=away == 0, place=place[keep], slot=slots[curve * ranges + to[keep]])

    rows = vectors.select("key", "packed", "step").mapInPandas(run, "key long, packed binary, step float, curve int, range int, own boolean, place long, slot long")
    return rows.repartition(len(slots), "slot").sortWithinPartitions("curve", "range", "place", "key")


def _stretches(batches: Iterator[pd.DataFrame], half: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """((curve, range), keys, vectors, own) of consecutive stretches of a sorted partition."""
    curve, keys, packed, steps, owned = None, [], [], [], []

    def flush():
        return curve, np.array(keys, np.int64), unpack(packed, np.array(steps)), np.array(owned, bool)

    for batch in batches:
        for c, r, k, p, s, o in zip(batch["curve"], batch["range"], batch["key"], batch["packed"], batch["step"], batch["own"]):
            if keys and ((c, r) != curve or len(keys) >= half):
                yield flush()
                keys, packed, steps, owned = [], [], [], []
            curve = (c, r)
            keys.append(k)
            packed.append(p)
            steps.append(s)
            owned.append(o)
    if keys:
        yield flush()


def _best(sims: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row and their keys."""
    if sims.shape[1] > k:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return np.take_along_axis(sims, at, 1), keys[at]
    return sims, np.broadcast_to(keys, sims.shape)


def nearest(df: DataFrame, key: str, text: str, dims: int, k: int = 10, half: int = HALF) -> DataFrame:
    """(key, neighbour, rank, similarity): for every usable vector its k most similar ones, rank 1 first."""
    vectors = prepared(df, key, text, dims)
    n = vectors.count()
    count = curves_for(n, half)
    curves = Curves(_sample(_rows(df, key, text), dims), count)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emit(keys, own, best):
            keys, sims, names = keys[own], best[0][own], best[1][own]
            keep = np.isfinite(sims)
            rows = [(a[g], b[g]) for a, b, g in zip(names, sims, keep)]
            return pd.DataFrame({"key": keys, "names": pd.Series([a for a, _ in rows], dtype=object), "sims": pd.Series([b for _, b in rows], dtype=object)})

        def join(a, b):
            sims, names = np.concatenate([a[0], b[0]], 1), np.concatenate([a[1], b[1]], 1)
            if sims.shape[1] <= k:
                return sims, names
            at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            return np.take_along_axis(sims, at, 1), np.take_along_axis(names, at, 1)

        def other(keys_a, keys_b, sims):
            return np.where(keys_a[:, None] == keys_b[None, :], -np.inf, sims)

        last = None  # curve and range, keys, vectors, own, best so far
        for curve, keys, x, own in _stretches(batches, half):
            best = _best(other(keys, keys, x @ x.T), keys, k)
            if last is not None and last[0] == curve:
                s = other(last[1], keys, last[2] @ x.T)
                yield emit(last[1], last[3], join(last[4], _best(s, keys, k)))
                best = join(best, _best(s.T, last[1], k))
            elif last is not None:
                yield emit(last[1], last[3], last[4])
            last = curve, keys, x, own, best
        if last is not None:
            yield emit(last[1], last[3], last[4])

    def best(first: int) -> DataFrame:
        """(key, z) of a group of curves: the k best, nearest first."""
        ordered = _ordered(vectors, curves, first, min(first + CURVES, count), n, half)
        found = ordered.select("curve", "range", "own", "key", "packed", "step").mapInPandas(run, "key long, names array<long>, sims array<float>")
        return merged(found.select("key", F.arrays_zip(F.transform("sims", lambda s: -s).alias("d"), F.col("names").alias("n")).alias("z")))

    def merged(lists: DataFrame) -> DataFrame:
        whole = lists.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("z"))).alias("z"))
        # a neighbour met on several curves has the same similarity to within rounding: keep its first place
        once = F.filter("z", lambda x, i: F.array_position(F.transform("z", lambda y: y["n"]), x["n"]) == i + 1)
        return whole.select("key", F.slice(once, 1, k).alias("z"))

    lists = best(0)
    for first in range(CURVES, count, CURVES):
        lists = merged(cut(lists).unionByName(best(first)))
    top = lists.select("key", F.posexplode("z").alias("pos", "x"))
    return top.select(F.col("key").alias(key), F.col("x.n").alias("neighbour"), (F.col("pos") + 1).alias("rank"), (-F.col("x.d")).cast("double").alias("similarity"))


def similar_pairs(near: DataFrame, key: str, least: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of at least `least` similarity where one is among the neighbours of the other."""
    close = near.where(F.col("similarity") >= least)
    return close.select(F.least(key, "neighbour").alias("id_a"), F.greatest(key, "neighbour").alias("id_b")).distinct()


def exact_nearest(df: DataFrame, key: str, text: str, dims: int, every: int, k: int = 10) -> DataFrame:
    """(key, neighbour, rank, similarity) by brute force, for the stated queries: keys divisible by `every`.

    The queries are compared with all vectors in blocks: at most about QUERIES of them go to the executors at a time, and
    every block returns its k best for each of them.
    """
    vectors = prepared(df, key, text, dims)
    spark = df.sparkSession
    queries = cut(vectors.where(F.col("key") % every == 0).select("key", "packed", "step", F.xxhash64("key").alias("h")))
    turns = max(1, -(-queries.count() // QUERIES))
    out = None
    for turn in range(turns):
        rows = queries.where(F.pmod("h", F.lit(turns)) == turn).orderBy("key").collect()  # about QUERIES
        held = spark.sparkContext.broadcast((np.array([r["key"] for r in rows], np.int64), [bytes(r["packed"]) for r in rows], np.array([r["step"] for r in rows], np.float32)))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            names, packed, steps = held.value
            q = unpack(packed, steps) if len(names) else None
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of the partition, by block of queries
            for batch in batches:
                keys = batch["key"].to_numpy()
                if q is None or not len(keys):
                    continue
                x = unpack(list(batch["packed"]), batch["step"].to_numpy())
                for begin in range(0, len(names), 1024):
                    own = names[begin : begin + 1024]
                    sims, near = _best(np.where(own[:, None] == keys[None, :], -np.inf, q[begin : begin + 1024] @ x.T), keys, k)
                    if begin in best:
                        sims, near = np.concatenate([best[begin][0], sims], 1), np.concatenate([best[begin][1], near], 1)
                        at = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                        sims, near = np.take_along_axis(sims, at, 1), np.take_along_axis(near, at, 1)
                    best[begin] = sims, near
            for begin, (sims, near) in best.items():
                part = pd.DataFrame({"key": np.repeat(names[begin : begin + 1024], sims.shape[1]), "n": near.ravel(), "s": sims.ravel().astype(np.float64)})
                yield part[np.isfinite(part["s"])]

        found = vectors.mapInPandas(run, "key long, n long, s double")
        ranked = found.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), "n"))), 1, k).alias("z"))
        out = ranked if out is None else out.unionByName(ranked)
    top = out.select("key", F.posexplode("z").alias("pos", "x"))
    return top.select(F.col("key").alias(key), F.col("x.n").alias("neighbour"), (F.col("pos") + 1).alias("rank"), (-F.col("x.d")).alias("similarity"))
