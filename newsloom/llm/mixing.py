"""Mix sources to target weights along a low-discrepancy schedule (problem 9).

Slots 0, 1, 2 ... are sent through the van der Corput sequence; the point of a slot picks the source in whose stretch
of the cumulative weights it falls. So every prefix of the schedule is close to the target shares. Each source's
documents are shuffled by a hash, laid end to end (again from the start for a repeat) and cut into blocks of equal
tokens; block r of a source goes to the source's slot number r.

The total is the largest at which every source can give its share with no document used more than its cap, or
`total_tokens`; with the latter a source that is too small stops at its cap, and the shares say so. A document belongs
to the mixture when its middle lies before the tokens its source needs. Documents over LARGE_TOKENS are chosen first, in
proportion, and the others make up exactly what is left, so a source ends within half a small document of its need. Weights are relative; sources without documents, and targets that are null or not positive, are left out and the
other weights scaled up. A source named by several target rows has the sum of their weights and the largest cap.
Documents without tokens, or of a source without a target, take no part. All weights zero or no documents: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.ranks import buckets_for, hash_bucket, running
from newsloom.session import cut

BLOCK_TOKENS = 4096
LARGE_TOKENS = 2048
SEED = 17
_BITS = 48
_SCHEMA = "position long, place long, source string, doc_id long, repeat_no long, tokens long"


def _targets(targets: DataFrame) -> DataFrame:
    good = targets.where("source is not null and target_weight > 0 and max_repeats >= 1")
    return good.groupBy("source").agg(F.sum("target_weight").alias("target_weight"), F.max("max_repeats").cast("long").alias("max_repeats"))


def _large() -> Column:
    return F.col("tokens") > LARGE_TOKENS


def _take(docs: DataFrame, wanted: dict[str, tuple[float, int]], spark) -> DataFrame:
    """The rows of `docs`, with repeat_no, whose middle lies before the tokens wanted of their source.

    wanted: {source: (tokens wanted, tokens there are)}."""
    limits = spark.createDataFrame([(s, float(w), int(h)) for s, (w, h) in wanted.items()], "source string, need double, have long")
    laid = running(docs, ["source"], "b", ["h", "doc_id", "tokens"], "before", "tokens").join(F.broadcast(limits), "source")
    times = F.ceil((F.col("need") - F.col("before") - F.col("tokens") / 2) / F.col("have")).cast("long")
    laid = laid.withColumn("times", F.least(times, F.col("max_repeats"))).where("times > 0")
    each = laid.withColumn("repeat_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return each.select("source", "doc_id", "repeat_no", "tokens", "h", "b")


def schedule(n: int, spark, names: list[str], shares: list[float]) -> DataFrame:
    """(slot, source) for slots 0 to n - 1."""
    cumulative, total = [], 0.0
    for x in shares:
        total += x
        cumulative.append(total)
    bits = F.reverse(F.lpad(F.bin("id"), _BITS, "0"))
    point = F.conv(bits, 2, 10).cast("double") / float(2**_BITS)
    edges = F.array(*[F.lit(x) for x in cumulative[:-1]]) if len(names) > 1 else F.array().cast("array<double>")
    passed = F.size(F.filter(edges, lambda e: e <= F.col("point")))
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("point"))
    return slots.select("slot", F.element_at(F.array(*[F.lit(x) for x in names]), passed + 1).alias("source"))


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(position, place, source, doc_id, repeat_no, tokens) in the order of (position, place); `sized` has doc_id, source, tokens.

    position: the slot of the document's block; place: the token of the block at which the document begins."""
    spark = sized.sparkSession
    docs = sized.where("tokens > 0 and source is not null").select("doc_id", "source", F.col("tokens").cast("long").alias("tokens"))
    docs = cut(docs.join(_targets(targets), "source").withColumn("h", F.xxhash64("doc_id", F.lit(SEED))))
    per = docs.groupBy("source").agg(F.first("target_weight").alias("w"), F.first("max_repeats").alias("cap"), F.sum("tokens").alias("have"), F.count("*").alias("n"), F.sum(F.when(_large(), F.col("tokens")).otherwise(0)).alias("large"))
    rows = sorted(per.collect(), key=lambda r: r["source"])  # one row for each source that has a target
    if not rows:
        return spark.createDataFrame([], _SCHEMA)
    weight = sum(r["w"] for r in rows)
    total = min(r["have"] * r["cap"] * weight / r["w"] for r in rows) if total_tokens is None else float(total_tokens)
    need = {r["source"]: min(total * r["w"] / weight, float(r["have"] * r["cap"])) for r in rows}
    buckets = buckets_for(sum(r["n"] for r in rows))
    docs = docs.withColumn("b", hash_bucket(F.col("h"), buckets))

    # Long documents first, in proportion, then the others for exactly what is left of the need.
    large = _take(docs.where(_large()), {r["source"]: (need[r["source"]] * r["large"] / r["have"], r["large"]) for r in rows if r["large"]}, spark)
    taken = {r["source"]: r["t"] for r in large.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    small = _take(docs.where(~_large()), {r["source"]: (need[r["source"]] - taken.get(r["source"], 0), r["have"] - r["large"]) for r in rows if r["have"] > r["large"]}, spark)
    used = large.unionByName(small).withColumn("b", F.col("repeat_no") * buckets + F.col("b"))
    used = running(used, ["source"], "b", ["h", "doc_id", "tokens"], "at", "tokens")
    used = used.select("source", "doc_id", "repeat_no", "tokens", F.floor(F.col("at") / block_tokens).cast("long").alias("block"), (F.col("at") % block_tokens).alias("place"))

    shares = [need[r["source"]] / sum(need.values()) for r in rows]
    blocks = sum(need.values()) / block_tokens
    n = math.ceil(blocks + (math.log2(blocks + 2) + 3) / min(shares)) + len(rows)
    slots = schedule(n, spark, [r["source"] for r in rows], shares).withColumn("chunk", F.floor(F.col("slot") / 200_000))
    numbered = running(slots, ["source"], "chunk", ["slot"], "block")
    placed = used.join(numbered.select("source", "block", "slot"), ["source", "block"], "left")
    last = F.lit(n).cast("long") + F.col("block")
    position = F.coalesce(F.col("slot"), last)
    return placed.select(position.alias("position"), "place", "source", "doc_id", "repeat_no", "tokens")


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, most_repeats, max_repeats) for every target row's source."""
    wanted = _targets(targets)
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.max(F.col("repeat_no") + 1).alias("most_repeats"))
    both = wanted.join(got, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tokens", "documents", "most_repeats")})
    there = both.where("tokens > 0")
    weights, total = there.agg(F.sum("target_weight")).scalar(), there.agg(F.sum("tokens")).scalar()
    return both.select(
        "source",
        F.when(F.col("tokens") > 0, F.col("target_weight") / weights).otherwise(0.0).alias("target_share"),
        F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)).alias("reached_share"),
        "tokens", "documents", "most_repeats", "max_repeats",
    )
