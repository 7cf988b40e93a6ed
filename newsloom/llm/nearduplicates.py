"""Group records that share most of their content (problem 2).

A record's text (its fields joined, white space collapsed, lower case) is the set of its substrings of WIDTH
characters; two records belong together where the Jaccard similarity of these sets is at least a threshold.

Fingerprints. 256 minima of one-permutation hashes of the set. Two bits of each make the whole fingerprint: the minima
in which two differ are close to 0.75 * BITS * (1 - Jaccard). Sixteen bits of each of BLOCK minima make a block of 64
bits; there are TABLES blocks.
Pivot distance tables. For each block the Hamming distances to REFERENCES reference fingerprints of 64 bits are
computed once: its coordinates. Reference words are pseudo-random, as block bits are uniform. Pairs whose coordinates
differ in every table, that is, whose largest coordinate difference is above 0 in all of them, are discarded; by the
triangle inequality that never discards a pair with an equal block. Each table is range-partitioned and sorted by its
coordinates, so that what isn't discarded stands side by side, and no other pair is ever formed.
Crowds. Rows of a table are ordered by further coordinates (two distances of one further minimum each, STEPS of them).
A run of equal coordinates is a node of a tree; a node of more than LEAF rows is divided by its next coordinates, and
so on to the end: where STEPS are used up, the next STEPS are fetched. In every node so divided each row is paired with the
node's leader, so records near it are linked to it and needn't go deeper. Within a leaf all pairs are candidates. A hot
node is cut by the range bounds; what a bound parts is looked at again from the rows beside the bounds.
Survivors meet their whole fingerprints' distance (`reach`) and then the exact Jaccard similarity of the sets.
Whole nodes. Dividing a node parts some of its pairs, and a pair right at the threshold may have no block in common. So
LONE further tables of single minima follow, whose nodes aren't divided: all records of a node that agree in three more
minima, whichever of its SPLITS * BESIDE / 3 threes (each table has its own), meet unless the links so far have put
them into one group. A pair of similarity 0.5 that no table has met before escapes all of them with a chance of some
3 in a million (simulated). Their rows carry the fingerprints, so pairs are formed and
discarded in place; nodes of more than CELL rows meet block by block. A further minimum is compared by six bits, two of
which the fingerprint has already. The tables are shuffled in ROUNDS, and the files of one are gone before the next.
Groups. Verified pairs are links; the smallest id of a connected component names its group. All pairs of a group are
compared (`links`).

Records with one and the same text are one record until the end. Null fields count as empty; texts shorter than WIDTH
characters have an empty set and no partners. Repeated rows of an id and text count once. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.ranks import sieve
from newsloom.session import cut, discarded, written

WIDTH = 12
BITS = 256
BLOCK = 4
TABLES = 48
REFERENCES = 8
STEPS = 8
LEAF = 16
ROWS = 400_000  # of a pivot table in one partition
SEED = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 400_000
LONE = 20
BESIDE = 48
SPLITS = 3
ROUNDS = 2
CELL = 100_000  # rows of a whole node that meet in one task, twice at most
MEET = 500_000  # pairs compared at once
DEVIATIONS = 4.5
INSIDE = 256  # members of a group that meet in one task
_WORDS = BITS // 64
_COLUMNS = np.arange(LONE + BESIDE) * 101 % BITS  # of the single minima
_KEYS = 56  # bits of packed coordinates; the table's number is above them
_TABLE = "id long, ha long, hb long, shingles int, filled int, f array<long>, coords array<long>, fine binary, lone array<int>, beside binary, text string"


def joined_text(*fields: str | None) -> str:
    """The fields joined by single spaces, nulls as empty, with white space collapsed, trimmed and in lower case."""
    return " ".join(" ".join(f if isinstance(f, str) else "" for f in fields).split()).lower()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(text: str) -> np.ndarray:
    """Hashes of the windows of WIDTH code points that start at each place of `text`, from hashes of half the width."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    b1, b2, b4 = (np.uint64(pow(0x100000001B3, k, 2**64)) for k in (1, 2, 4))
    two = c[:-1] * b1 + c[1:]
    four = two[:-2] * b2 + two[2:]
    eight = four[:-4] * b4 + four[4:]
    return _mix(eight[:-4] * b4 + four[8:])


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, BITS) minima of the window hashes, the number of windows, and how many bins they fill, of each text.

    Two passes of BITS / 2 bins each; an empty bin takes the value of the next filled one of its pass, so short texts
    compare as well.
    """
    half = BITS // 2
    spans = np.array([max(0, len(t) - WIDTH + 1) for t in texts])
    out = np.full((len(texts), BITS), np.uint64(2**64 - 1))
    joined = "".join(texts)
    if len(joined) >= WIDTH:
        h = window_hashes(joined)
        starts = np.cumsum([0, *(len(t) for t in texts[:-1])])
        row = np.repeat(np.arange(len(texts)), spans)
        at = np.arange(len(row)) - np.repeat(np.cumsum([0, *spans[:-1]]), spans) + np.repeat(starts, spans)
        h = h[at]
        flat = out.ravel()
        for turn in range(2):
            g = h if turn == 0 else _mix(h ^ SEED)
            np.minimum.at(flat, row * BITS + turn * half + (g >> np.uint64(57)).astype(np.int64), g & np.uint64(2**57 - 1))
    filled_bins = (out != np.uint64(2**64 - 1)).sum(1)
    for turn in range(2):
        part = out[:, turn * half : (turn + 1) * half]
        empty = part == np.uint64(2**64 - 1)
        for k in np.flatnonzero(empty.any(1) & ~empty.all(1)):
            filled = np.flatnonzero(~empty[k])
            gaps = np.flatnonzero(empty[k])
            source = filled[np.searchsorted(filled, gaps) % len(filled)]
            part[k, gaps] = _mix(part[k, source] + ((gaps - source) % half).astype(np.uint64)) >> np.uint64(7)
    return out, spans, filled_bins


def fingerprints(minima: np.ndarray) -> np.ndarray:
    """(n, 2 * BITS / 64) words of two bits of each minimum: those of the first bits, then those of the second."""
    mixed = _mix(minima)
    planes = [np.packbits((mixed >> np.uint64(k) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64) for k in range(2)]
    return np.concatenate(planes, axis=1)


def references() -> tuple[np.ndarray, np.ndarray]:
    """(TABLES, REFERENCES) words of 64 bits for the blocks, and two of 16 bits for single minima."""
    k = np.arange(TABLES * REFERENCES, dtype=np.uint64) * SEED + np.uint64(1)
    return _mix(_mix(k)).reshape(TABLES, REFERENCES), (_mix(np.array([11, 12], np.uint64) * SEED) & np.uint64(0xFFFF)).astype(np.uint16)


def pivot_coordinates(minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, TABLES) packed distances of every block to its references, seven bits each below the table's number; and
    (n, TABLES * BLOCK) bytes of the two distances of every single minimum."""
    words, singles = references()
    used = (_mix(minima[:, : TABLES * BLOCK]) & np.uint64(0xFFFF)).astype(np.uint16)
    blocks = np.ascontiguousarray(used).view(np.uint64)
    keys = np.broadcast_to(np.arange(TABLES, dtype=np.uint64), blocks.shape)
    for r in range(REFERENCES):
        keys = keys << np.uint64(7) | np.bitwise_count(blocks ^ words[:, r]).astype(np.uint64)
    near = [np.minimum(np.bitwise_count(used ^ w), 15).astype(np.uint8) for w in singles]
    return keys.view(np.int64), near[0] << np.uint8(4) | near[1]


def single_blocks(minima: np.ndarray) -> np.ndarray:
    """Single minima from all over the signature, each filling a whole block, for `pivot_coordinates`."""
    return np.repeat(minima[:, _COLUMNS[:TABLES]], BLOCK, axis=1)


def single_coordinates(coords: np.ndarray) -> np.ndarray:
    """(n, LONE): the pivot coordinates of `single_blocks`, hashed to an int each that ends with the table's number."""
    h = _mix(coords[:, :LONE].view(np.uint64))
    return (h >> np.uint64(38)).astype(np.int32) << 5 | np.arange(LONE, dtype=np.int32)


def beside_bits(minima: np.ndarray) -> np.ndarray:
    """(n, BESIDE / 2) bytes: four bits of each further minimum besides the two that `fingerprints` has."""
    mixed = _mix(minima[:, _COLUMNS[LONE : LONE + BESIDE]])
    return np.concatenate([np.packbits((mixed >> np.uint64(k) & np.uint64(1)).astype(np.uint8), axis=1) for k in range(2, 6)], axis=1)


def beside_values(prints: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(n, BESIDE): six bits of each further minimum, from the fingerprints and `beside_bits`."""
    own = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1).reshape(len(prints), 2, BITS)[:, :, _COLUMNS[LONE : LONE + BESIDE]]
    planes = np.concatenate([own, np.unpackbits(bits, axis=1).reshape(len(prints), 4, BESIDE)], axis=1)
    return sum((planes[:, k] << k for k in range(6)), np.zeros((len(prints), BESIDE), np.uint8))


def threes() -> np.ndarray:
    """(LONE, SPLITS * BESIDE / 3, 3): for each table the further minima divided into threes, SPLITS times."""
    turns = [np.random.default_rng(k).permutation(BESIDE) for k in range(LONE * SPLITS)]
    return np.stack(turns).reshape(LONE, SPLITS * BESIDE // 3, 3)


def neighbours_in_order(keys: np.ndarray, steps: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of one sorted run of a pivot table, as places (first, second); and the leader's place of every
    row whose node is still larger than `leaf` after all its steps, else -1.

    A row's node at depth 0 are the rows of its key, at depth d those that share d steps as well. Pairs that a division
    parts aren't among the candidates; `_whole_nodes` finds them."""
    n = len(keys)
    same = np.concatenate([[False], keys[1:] == keys[:-1]])
    depth = same.astype(np.int64)  # with how many coordinates a row agrees with the one before it
    apart = np.concatenate([[np.uint64(0)], steps[1:].view(np.uint64) ^ steps[:-1].view(np.uint64)])
    for d in range(STEPS):
        depth += same & (apart >> np.uint64(8 * (STEPS - 1 - d)) == 0)
    place = np.arange(n)
    first, second = [], []
    leaf_of = np.full(n, -1)
    leader = np.full(n, -1)
    for d in range(STEPS + 1):
        begins = np.flatnonzero(depth <= d)
        node = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))
        large = np.diff(np.append(begins, n))[node] > leaf
        crowd = np.flatnonzero((leaf_of < 0) & large & (begins[node] != leader) & (begins[node] != place))
        first.append(begins[node[crowd]])
        second.append(crowd)
        leader = np.where((leaf_of < 0) & large, begins[node], -1)
        leaf_of = np.where((leaf_of < 0) & ~large, d * n + node, leaf_of)
    for apart_by in range(1, leaf):
        near = np.flatnonzero((leaf_of[:-apart_by] >= 0) & (leaf_of[:-apart_by] == leaf_of[apart_by:])) if apart_by < n else np.zeros(0, np.int64)
        first.append(near)
        second.append(near + apart_by)
    return np.concatenate(first), np.concatenate(second), leader


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct hashes."""
    if not len(a) or not len(b):
        return 0.0
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common)


def radius(threshold: float) -> int:
    """Distance of fingerprints of one bit for a first choice: pairs right at the threshold lie within it up to 2.5 standard deviations. `_whole_nodes` and `links` find what it loses."""
    p = (1 - threshold) / 2
    return int(BITS * p + 2.5 * (BITS * p * (1 - p)) ** 0.5)


def reach(filled: Column, threshold: float) -> Column:
    """Distance of fingerprints of two bits up to DEVIATIONS standard deviations above that of a pair right at the threshold, for a record that fills `filled` of BITS bins: where few are filled the others repeat them, and distances vary more. BITS passes everything."""
    p = 0.75 * (1 - threshold)
    share = filled / F.lit(float(BITS))
    return F.least(F.lit(BITS), F.floor(BITS * p + DEVIATIONS * (BITS * p * (1 - p)) ** 0.5 * F.sqrt((2 - share) / share))).cast("int")


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """Within it the files of a shuffle go as soon as the query that made them has ended, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Records:
    """The fingerprint table of a collection of records, written to the shared folder."""

    def __init__(self, spark: SparkSession, df: DataFrame, key: str, fields: list[str]):
        rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), *[F.col(f"`{f}`").cast("string").alias(f"f{k}") for k, f in enumerate(fields)]).where("id is not null")
        columns = [f"f{k}" for k in range(len(fields))]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = [joined_text(*fields) for fields in zip(*(batch[c] for c in columns))]
                ids = batch["id"].to_numpy()
                begin = 0
                while begin < len(texts):
                    end, size = begin, 0
                    while end < len(texts) and (end == begin or size + len(texts[end]) < CHUNK):
                        size += len(texts[end])
                        end += 1
                    part = texts[begin:end]
                    minima, spans, filled = signatures(part)
                    coords, fine = pivot_coordinates(minima)
                    lone = single_coordinates(pivot_coordinates(single_blocks(minima))[0])
                    digests = np.array([np.frombuffer(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest(), "<i8") for t in part])
                    yield pd.DataFrame(
                        {
                            "id": ids[begin:end], "ha": digests[:, 0], "hb": digests[:, 1], "shingles": spans.astype(np.int32), "filled": filled.astype(np.int32), "f": list(fingerprints(minima).view(np.int64)),
                            "coords": list(coords), "fine": [x.tobytes() for x in fine], "lone": list(lone), "beside": [x.tobytes() for x in beside_bits(minima)], "text": part,
                        }
                    )
                    begin = end

        every = written(rows.mapInPandas(run, _TABLE), "records")
        # one record for each text; its smallest id stands for it. An id with several texts has the one of least digest.
        full = every.where("shingles > 0")
        digests = full.groupBy("id").agg(F.min(F.struct("ha", "hb")).alias("d")).select("id", "d.ha", "d.hb")
        members = digests.groupBy("ha", "hb").agg(F.min("id").alias("rep"))
        self.same = cut(digests.join(members, ["ha", "hb"]).select("id", "rep", "ha", "hb"))
        idle = cut(full.select("id", "ha", "hb").distinct().join(self.same.where("id = rep"), ["id", "ha", "hb"], "left_anti"))
        self.alone = cut(every.where("shingles = 0").select("id").distinct().join(self.same.select("id"), "id", "left_anti"))
        # the table of the heads is made once, so that no step after this shuffles whole records
        keep = sieve(idle, "id")
        heads = keep(full, "id", inside=False).unionByName(keep(full, "id").join(idle, ["id", "ha", "hb"], "left_anti"))
        self.heads = written(heads.drop("ha", "hb", "shingles"), "heads")
        discarded(every)


def _sorted(rows: DataFrame, partitions: int | None) -> DataFrame:
    """(kind, key, a, b) from rows (key, steps, id) of pivot tables: pairs (0), rows beside a bound (1: id, steps), rows
    of nodes that need further steps (2: id, leader; key is the node's). Without `partitions` no node is cut."""
    order = ["key", "steps", "id"]
    placed = rows.repartitionByRange(partitions, *order) if partitions else rows.repartition("key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # ROWS or so, by the range bounds
        whole = pd.concat(parts) if parts else None
        if whole is None or not len(whole):
            return
        keys, steps, ids = (whole[c].to_numpy() for c in order)
        first, second, leader = neighbours_in_order(keys, steps)
        a, b = np.minimum(ids[first], ids[second]), np.maximum(ids[first], ids[second])
        pairs = np.unique(np.stack([a, b], 1)[a < b], axis=0)
        yield pd.DataFrame({"kind": np.int8(0), "key": np.int64(0), "a": pairs[:, 0], "b": pairs[:, 1]})
        if partitions:
            ends = [np.flatnonzero(keys == keys[0])[: LEAF + 1], np.flatnonzero(keys == keys[-1])[-LEAF - 1 :]]
            beside = np.unique(np.concatenate(ends))
            yield pd.DataFrame({"kind": np.int8(1), "key": keys[beside], "a": ids[beside], "b": steps[beside]})
        deep = np.flatnonzero((leader >= 0) & (leader != np.arange(len(keys))))
        node = (_mix(keys.view(np.uint64) ^ _mix(steps.view(np.uint64) + SEED)) & np.uint64(2**_KEYS - 1)).view(np.int64) | keys >> _KEYS << _KEYS
        yield pd.DataFrame({"kind": np.int8(2), "key": node[deep], "a": ids[deep], "b": ids[leader[deep]]})

    return placed.sortWithinPartitions(*order).mapInPandas(run, "kind byte, key long, a long, b long")


def _steps(fine: Column, table: Column, level: int) -> Column:
    """The packed coordinates of STEPS further minima of a table's order, those of `level` (from 0)."""
    size = TABLES * BLOCK
    start = F.pmod((table + 1) * BLOCK + level * STEPS, F.lit(size)) + 1
    return F.conv(F.hex(F.substring(F.concat(fine, fine), start, F.lit(STEPS))), 16, -10).cast("long")


def _candidates(heads: DataFrame, limit: int) -> DataFrame:
    """(a, b), a < b: the pairs that the pivot tables don't discard. limit: see `radius`."""
    table = F.shiftrightunsigned("key", _KEYS).cast("int")
    rows = heads.select("id", "fine", F.explode("coords").alias("key")).select("key", _steps(F.col("fine"), table, 0).alias("steps"), "id")
    n = heads.count() * TABLES
    found = written(_sorted(rows, max(1, -(-n // ROWS))), "candidates")
    edges = written(_sorted(found.where("kind = 1").select("key", F.col("b").alias("steps"), F.col("a").alias("id")), None), "edges")
    out = found.unionByName(edges)
    pairs, deep = out.where("kind = 0").select("a", "b"), out.where("kind = 2").select("key", "a", "b")
    prints = heads.select("id", F.slice("f", 1, _WORDS).alias("f"), "fine")
    for level in range(1, TABLES * BLOCK // STEPS):
        n = deep.count()
        if not n:
            break
        # rows surely similar to their leader are linked to it; the others go deeper
        steps = _steps(F.col("fine"), table, level).alias("steps")
        placed = deep.join(prints.select(F.col("id").alias("a"), "f", "fine"), "a").select("key", "a", "b", "f", steps)
        far = placed.join(prints.select(F.col("id").alias("b"), F.col("f").alias("g")), "b").where(_distance("f", "g") > limit // 2)
        leaders = deep.select("key", "b").distinct().join(prints.select(F.col("id").alias("b"), "fine"), "b").select("key", F.col("b").alias("a"), steps)
        lower = far.select("key", "a", "steps").unionByName(leaders).select("key", "steps", F.col("a").alias("id"))
        found = written(_sorted(lower, max(1, -(-n // ROWS))), "deeper")
        edges = _sorted(found.where("kind = 1").select("key", F.col("b").alias("steps"), F.col("a").alias("id")), None)
        out = found.unionByName(edges)
        pairs, deep = pairs.unionByName(out.where("kind = 0").select("a", "b")), cut(out.where("kind = 2").select("key", "a", "b").distinct())
    return pairs.repartition("a").distinct()  # placed for `_near` at once


def _distance(a: str, b: str, planes: int = 1) -> Column:
    """In how many minima two fingerprints differ, by one bit of each or by two."""
    apart = [F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))) for k in range(planes * _WORDS)]
    return sum((F.bit_count(apart[k].bitwiseOR(apart[k + _WORDS]) if planes > 1 else apart[k]) for k in range(_WORDS)), F.lit(0))


def _near(pairs: DataFrame, prints: DataFrame, planes: int) -> DataFrame:
    """The pairs (a, b) whose fingerprints, from (id, f, r), are within the reach r of both."""
    left = pairs.join(prints.select(F.col("id").alias("a"), F.col("f").alias("fa"), F.col("r").alias("ra")), "a")
    both = left.join(prints.select(F.col("id").alias("b"), F.col("f").alias("fb"), F.col("r").alias("rb")), "b")
    return both.where(_distance("fa", "fb", planes) <= F.least("ra", "rb")).select("a", "b").distinct()


def _meetings(node: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with one node and two groups, MEET or so at once; rows come in the order of `group`. Two nodes
    may rarely count as one."""
    place = np.arange(len(node))
    packed = np.sort(_mix(node) & ~np.uint64(2**24 - 1) | place.astype(np.uint64))  # faster than an argsort
    order = (packed & np.uint64(2**24 - 1)).astype(np.int64)
    node, group = packed >> np.uint64(24), group[order]
    opens = np.concatenate([[True], node[1:] != node[:-1]])
    begin = np.maximum.accumulate(np.where(opens, place, 0))
    own = np.maximum.accumulate(np.where(opens | np.concatenate([[True], group[1:] != group[:-1]]), place, 0))
    some = np.flatnonzero(own > begin)
    partners = (own - begin)[some]
    upto = np.cumsum(partners)
    at = 0
    while at < len(some):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MEET, "right")))
        n = partners[at:end]
        second = np.repeat(some[at:end], n)
        first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[second]
        yield order[first], order[second]
        at = end


def _whole_nodes(heads: DataFrame, head_of: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of records of different groups within reach that share a node of the tables of single minima."""
    lone = heads.select(F.explode("lone").alias("key"))
    sizes = lone.groupBy("key").agg(F.count("*").alias("n"))
    hot = cut(sizes.where(F.col("n") > CELL).select("key", F.ceil(F.col("n") / CELL).cast("int").alias("blocks")))  # at most LONE / CELL of the records
    prints = heads.select("id", "f", "beside", reach(F.col("filled"), threshold).alias("r"), "lone").join(head_of.select("id", "head"), "id", "left")
    prints = written(prints.withColumn("head", F.coalesce("head", "id")), "prints")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # some CELL rows
        whole = pd.concat(parts).sort_values("head", ignore_index=True) if parts else None
        if whole is None or not len(whole):
            return
        ids, group, within, own = (whole[c].to_numpy() for c in ("id", "head", "r", "own"))
        low, high = whole["low"].to_numpy(), whole["high"].to_numpy()
        prints = np.stack(list(whole["f"])).view(np.uint64)
        beside = beside_values(prints, np.frombuffer(b"".join(whole["beside"]), np.uint8).reshape(len(whole), BESIDE // 2))
        planes, most = np.ascontiguousarray(prints.T), within.max()
        key, place, parts_of = whole["key"].to_numpy(), np.arange(len(whole)), threes()
        node = _mix(key.astype(np.uint64) ^ _mix(low.astype(np.uint64) << np.uint64(32) | high.astype(np.uint64)))
        found = []
        for k in range(parts_of.shape[1]):
            x, y, z = (beside[place, parts_of[key & 31, k, side]].astype(np.uint64) for side in range(3))
            for i, j in _meetings(node ^ _mix(x << np.uint64(16) | y << np.uint64(8) | z), group):
                far = np.zeros(len(i), np.int16)
                for w in range(_WORDS):  # word by word, several times as fast as whole rows
                    far += np.bitwise_count(planes[w].take(i) ^ planes[w].take(j) | planes[w + _WORDS].take(i) ^ planes[w + _WORDS].take(j))
                close = np.flatnonzero(far <= most)
                i, j, far = i[close], j[close], far[close]
                keep = (far <= np.minimum(within[i], within[j])) & ((low[i] == high[i]) | (own[i] != own[j]))
                i, j = i[keep], j[keep]
                found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    n = prints.count() * LONE
    rounds = min(ROUNDS, -(-n // CELL)) or 1
    found = []
    for tables in np.array_split(np.arange(LONE), rounds):
        keys = F.slice("lone", int(tables[0]) + 1, len(tables))
        rows = prints.select("id", "head", "f", "beside", "r", F.explode(keys).alias("key")).join(F.broadcast(hot), "key", "left")
        blocks = F.coalesce("blocks", F.lit(1))
        every = rows.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        cell = every.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "head", "r", "f", "beside")
        partitions = max(prints.sparkSession.sparkContext.defaultParallelism, -(-n * len(tables) // (LONE * CELL)))
        found.append(cut(cell.repartition(partitions, "key", "low", "high").mapInPandas(run, "a long, b long")))
    discarded(prints)
    return reduce(DataFrame.unionByName, found).distinct()


def _verify(pairs: DataFrame, records: Records, threshold: float) -> DataFrame:
    """(a, b) of `pairs` whose sets have at least `threshold` Jaccard similarity."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    keep = sieve(used, "id")
    texts = keep(records.heads.select("id", "text"), "id")
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}

        def windows(k: int, t: str) -> np.ndarray:
            if k not in known:
                if len(known) > 2000:
                    known.clear()
                known[k] = np.unique(window_hashes(t))
            return known[k]

        for batch in batches:
            keep = [jaccard(windows(a, ta), windows(b, tb)) >= threshold for a, ta, b, tb in zip(batch["a"], batch["ta"], batch["b"], batch["tb"])]
            yield batch.loc[keep, ["a", "b"]]

    return both.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, head): the smallest id of the connected component of every linked id, by alternating label steps."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("head")).select(F.col("a").alias("id"), "head"))
    while True:
        seen = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("head").alias("near"))
        jump = labels.select(F.col("id").alias("j"), F.col("head").alias("far"))
        stepped = labels.join(seen, labels.id == seen.a, "left").select("id", "head", F.least("head", "near").alias("next"))
        stepped = stepped.join(jump, stepped.next == jump.j, "left").select("id", F.col("head").alias("old"), F.least("next", F.coalesce("far", "next")).alias("head"))
        stepped = cut(stepped)
        if stepped.where("old <> head").limit(1).count() == 0:
            return stepped.select("id", "head")
        labels = stepped.select("id", "head")


class Duplicates:
    """Near-duplicates of a collection: links between distinct texts, groups, and all pairs."""

    def __init__(self, spark: SparkSession, df: DataFrame, key: str, fields: list[str], threshold: float):
        self.threshold = threshold
        with _released(spark):
            self.records = Records(spark, df, key, fields)
            heads = self.records.heads
            limit = radius(threshold)
            first = heads.select("id", F.slice("f", 1, _WORDS).alias("f"), F.lit(limit).alias("r"))
            near = cut(_near(_candidates(heads, limit), first, 1))
            self.met = cut(_verify(near, self.records, threshold))
            self.head_of = components(self.met)
            across = cut(_verify(cut(_whole_nodes(heads, self.head_of, threshold)), self.records, threshold))
            if across.limit(1).count():
                self.met = self.met.unionByName(across)
                self.head_of = components(self.met)

    def links(self) -> DataFrame:
        """(a, b): all pairs of distinct texts at or above the threshold: those met, and the others inside each group.

        The members of a group meet block by block, so that no task has more than two blocks of INSIDE members."""
        sizes = self.head_of.groupBy("head").agg(F.ceil(F.count("*") / INSIDE).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 2").select("head", "blocks")
        placed = self.head_of.join(sizes, "head").select("id", "head", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"))
        every = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        cell = every.select("id", "own", "head", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        same = ["head", "low", "high"]
        inside = cell.select(*same, F.col("id").alias("a"), F.col("own").alias("oa")).join(cell.select(*same, F.col("id").alias("b"), F.col("own").alias("ob")), same).where("a < b and (low = high or oa <> ob)")
        missed = inside.select("a", "b").join(self.met, ["a", "b"], "left_anti")
        prints = self.records.heads.select("id", "f", reach(F.col("filled"), self.threshold).alias("r"))
        return self.met.unionByName(_verify(cut(_near(missed, prints, 2)), self.records, self.threshold))

    def groups(self) -> DataFrame:
        """(id, group_id) of every record; group_id is the smallest id of its group."""
        same = self.records.same.select("id", "rep")
        members = same.join(self.head_of.select(F.col("id").alias("rep"), "head"), "rep", "left").select("id", F.coalesce("head", "rep").alias("group_id"))
        return members.groupBy("id").agg(F.min("group_id").alias("group_id")).unionByName(self.records.alone.select("id", F.col("id").alias("group_id")))

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: all pairs of records at or above the threshold, copies included."""
        same = self.records.same.select("id", "rep")
        with _released(same.sparkSession):
            one = cut(self.links())
        links = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
        across = links.join(same.select(F.col("rep").alias("a"), F.col("id").alias("id_a")), "a").join(same.select(F.col("rep").alias("b"), F.col("id").alias("id_b")), "b").select("id_a", "id_b")
        several = same.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
        copies = same.join(several, "rep", "left_semi")
        copies = copies.alias("x").join(copies.alias("y"), "rep").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
        return across.unionByName(copies).where("id_a < id_b").distinct()
