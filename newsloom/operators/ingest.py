"""Deduplication and bookkeeping of incoming articles."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import publisher_identity, publisher_slug
from newsloom.functions.urls import canonical_url, url_key


def keyed(articles: DataFrame, url: str = "url") -> DataFrame:
    """Adds canonical_url and url_key; rows with a blank url are dropped, as they can't be told apart."""
    return articles.where(F.trim(url) != "").withColumns({"canonical_url": canonical_url(F.col(url)), "url_key": url_key(F.col(url))})


def first_of_each(rows: DataFrame, key: str, order: list[str], copies: str | None = None) -> DataFrame:
    """The first row of each key in the given order; `copies` names a column that counts the key's rows.

    A partial minimum on each side of the shuffle, so a hot key never gathers its rows in one task.
    """
    place = F.struct(*[F.col(c) for c in order])
    names = [c for c in rows.columns if c != key]
    count = [F.count("*").alias(copies)] if copies else []
    firsts = rows.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in names]), place).alias("__row"), *count)
    return firsts.select(key, *[F.col(f"__row.`{c}`").alias(c) for c in names], *([copies] if copies else []))


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the known ones."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def counters(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(entries_seen, distinct_new, duplicates) of a batch against what is stored: in-batch copies and stored ones are duplicates."""
    stored = known.select(F.col(key).alias("__k"), F.lit(1).alias("stored")).distinct()
    per = rows.groupBy(key).agg(F.count("*").alias("n")).join(stored, F.col(key) == F.col("__k"), "left")
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries_seen"),
        F.count_if(F.col("stored").isNull()).alias("distinct_new"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count_if(F.col("stored").isNull())).alias("duplicates"),
    )


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest event of each key: the state of an append-only ledger."""
    names = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in names]), F.struct(*[F.col(c) for c in order])).alias("__row"))
    return last.select(key, *[F.col(f"__row.`{c}`").alias(c) for c in names])


def change_set(stored: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, change): what makes `stored` equal to `wanted`: created, updated, unchanged or orphan (reported, never deleted)."""
    columns = [c for c in wanted.columns if c != key]
    a = stored.select(F.col(key).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in columns], F.lit(True).alias("__in_a"))
    b = wanted.select(F.col(key).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in columns], F.lit(True).alias("__in_b"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    change = F.when(F.col("__in_a").isNull(), "created").when(F.col("__in_b").isNull(), "orphan").when(same, "unchanged").otherwise("updated")
    return both.select(F.coalesce("__a", "__b").alias(key), change.alias("change"))


def replaced(bridge: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """A bridge table with the rows of exactly this batch's keys exchanged."""
    return bridge.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def is_expired(stamp: str, now: str, interval: str) -> Column:
    return F.coalesce(F.col(stamp) < F.expr(f"timestamp_ntz'{now}' - INTERVAL {interval}"), F.lit(False))


def expired(rows: DataFrame, stamp: str, now: str, interval: str) -> DataFrame:
    """Rows older than `interval` before `now`, strictly."""
    return rows.where(F.col(stamp) < F.expr(f"timestamp_ntz'{now}' - INTERVAL {interval}"))


def kept(rows: DataFrame, stamp: str, now: str, interval: str) -> DataFrame:
    """The rows that `expired` doesn't return; rows without a stamp stay."""
    return rows.where(~is_expired(stamp, now, interval))


def resolved_publishers(names: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, source_id) of every distinct publisher name: the source whose feed_url is made of the name, else the first
    one (by id) of the same identity; a discovered source counts only under its exact name. Null where there is none or
    the name is blank.

    names: (name); sources: (id, name, feed_url, kind). Two equi-joins, each reduced by a partial minimum."""
    wanted = names.select(F.trim("name").alias("name")).where("name <> ''").distinct()
    wanted = wanted.withColumns({"__feed": F.concat(F.lit("gnews://"), publisher_slug(F.col("name"))), "__who": publisher_identity(F.col("name"))})
    exact = sources.groupBy(F.col("feed_url").alias("__feed")).agg(F.min("id").alias("exact"))
    alike = sources.select(F.col("id").alias("__id"), F.col("name").alias("__name"), F.coalesce("kind", F.lit("rss")).alias("__kind"), publisher_identity(F.col("name")).alias("__who"))
    same = wanted.select("name", "__who").join(alike, "__who").where("__kind <> 'discovered' or __name = name").groupBy("name").agg(F.min("__id").alias("alike"))
    found = wanted.join(exact, "__feed", "left").join(same, "name", "left")
    return found.select("name", F.coalesce("exact", "alike").alias("source_id"))


def owned(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries (source_id, publisher, url, ...) filed under the publisher that wrote them.

    Rows with a blank url are dropped, and so are those that name a publisher no source is found for."""
    who = resolved_publishers(entries.select(F.col("publisher").alias("name")), sources).select(F.col("name").alias("__name"), F.col("source_id").alias("__owner"))
    joined = entries.where("trim(url) <> ''").join(who, F.trim("publisher") == F.col("__name"), "left")
    kept = joined.where("coalesce(trim(publisher), '') = '' or __owner is not null")
    return kept.withColumn("source_id", F.coalesce("__owner", "source_id")).drop("__name", "__owner")


def fresh(rows: DataFrame, known: DataFrame, key: str, order: list[str], limit: int | None = None) -> DataFrame:
    """The first row of each unseen key, in `order`, at most `limit` of them."""
    out = unseen(first_of_each(rows, key, order), known, key)
    return out if limit is None else out.orderBy(*order).limit(limit)


def backfilled_keys(rows: DataFrame, ident: str, key: str) -> DataFrame:
    """(ident, key): the key stays with the lowest ident and becomes null on its copies."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ident).alias("__first"))
    return rows.select(ident, key).join(first, key, "left").select(ident, F.when(F.col(ident) == F.col("__first"), F.col(key)).alias(key))


def with_parent_ids(rows: DataFrame, ident: str, name: str, parent: str) -> DataFrame:
    """`rows` with parent_id: the id of the row that `parent` names; null where it names none."""
    ids = rows.groupBy(F.col(name).alias("__name")).agg(F.min(ident).alias("parent_id"))
    return rows.join(ids, F.col(parent) == F.col("__name"), "left").drop("__name")


def seeded_if_empty(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """The rows to insert: the defaults where nothing is stored yet, none otherwise."""
    return defaults if stored.isEmpty() else defaults.limit(0)


def synthetic_backlog(spark: SparkSession, count: int, now: str, offset: int = 0, prefix: str = "https://demo.invalid/") -> DataFrame:
    """(url, url_key, title, published_at) of `count` made-up articles, a minute apart, the newest first."""
    name = F.concat(F.lit(f"{offset}-"), F.col("id").cast("string"))
    rows = spark.range(count).select(F.concat(F.lit(prefix), name).alias("url"), F.concat(F.lit("Synthetic fixture article "), name).alias("title"), (F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("published_at"))
    return rows.select("url", url_key(F.col("url")).alias("url_key"), "title", "published_at")


def runs(rows: DataFrame, key: str, order: list[str], failed: str, bucket: Column) -> DataFrame:
    """Adds consecutive_failures: the length of the run of failures up to each row of its key; a success starts anew.

    `bucket` must not fall as the order rises (a day of the first order column, say). Runs are counted within each
    (key, bucket); a run that a bucket begins with is carried on from a table of one row for each (key, bucket), so a
    hot key is as many tasks as it has buckets.
    """
    bad = F.when(F.col(failed), 1).otherwise(0)
    within = Window.partitionBy(key, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    islands = rows.withColumn("__b", bucket).withColumn("__island", F.sum(1 - bad).over(within))
    inside = Window.partitionBy(key, "__b", "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = islands.withColumn("__run", F.sum(bad).over(inside))
    ends = local.groupBy(key, "__b").agg(F.max("__island").alias("good"), F.max_by("__run", F.struct("__island", *order)).alias("tail"))
    by_bucket = Window.partitionBy(key).orderBy("__b")
    chains = ends.withColumn("__chain", F.sum(F.when(F.col("good") > 0, 1).otherwise(0)).over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)))
    carried = F.sum("tail").over(Window.partitionBy(key, "__chain").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    chains = chains.withColumn("__total", carried).withColumn("__carry", F.coalesce(F.lag("__total").over(by_bucket), F.lit(0)))
    joined = local.join(chains.select(key, "__b", "__carry"), [key, "__b"])
    full = F.col("__run") + F.when(F.col("__island") == 0, F.col("__carry")).otherwise(0)
    return joined.withColumn("consecutive_failures", full).drop("__b", "__island", "__run", "__carry")


def with_defaults(rows: DataFrame, dimension: DataFrame, key: str, defaults: dict) -> DataFrame:
    """A left join to a dimension whose missing rows and nulls take default values."""
    extra = dimension.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in defaults])
    joined = rows.join(extra, F.col(key) == F.col("__k"), "left")
    return joined.select(*[F.col(c) for c in rows.columns], *[F.coalesce(f"__{c}", F.lit(v)).alias(c) for c, v in defaults.items()])


def allowed_by_robots(requests: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """`requests` (host, url) with `allowed`, from fetched rules (host, status, body).

    401 and 403 deny all, other 4xx allow all, 5xx and hosts without an answer deny; a body is read as robots rules.
    """
    @F.pandas_udf(T.BooleanType())
    def decide(status: pd.Series, body: pd.Series, url: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}
        out = []
        for s, b, u in zip(status, body, url):
            if s != s or s is None or s in (401, 403) or s >= 500:
                out.append(False)
            elif s >= 400:
                out.append(True)
            else:
                text = b if isinstance(b, str) else ""
                if text not in parsed:
                    parsed[text] = RobotFileParser()
                    parsed[text].parse(text.splitlines())
                out.append(parsed[text].can_fetch(agent, u))
        return pd.Series(out, dtype=bool)

    joined = requests.join(rules.select("host", "status", "body"), "host", "left")
    return joined.withColumn("allowed", decide("status", "body", "url")).drop("status", "body")
