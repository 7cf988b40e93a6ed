"""Filtered, keyset-paginated feeds over articles and their bridges.

An article row needs id, source_id and a sort key column `sort_ts`; callers compute it once (coalesce of published and
created time) so that every filter compares a plain column. Null sort keys come last and take part in no time filter.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import cursor
from newsloom.session import cut

MAX_VALUES, MAX_LIMIT, KEPT_DAYS = 50, 50, 90


def csv_values(text: str | None) -> list[str]:
    """A comma-separated parameter: trimmed, lower case, empties dropped; no values mean no filter."""
    values = [v for v in (x.strip().lower() for x in (text or "").split(",")) if v]
    if len(values) > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} values")
    return values


@dataclass
class FeedRequest:
    """What a reader asks for, validated on the driver."""

    countries: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    language: str | None = None
    sources: list[int] = field(default_factory=list)
    day: date | None = None
    since: datetime | None = None
    days: int | None = None
    now: datetime | None = None
    after: tuple[datetime, int] | None = None
    limit: int = 20

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= MAX_LIMIT:
            raise ValueError("limit out of range")
        if self.days is not None and not 1 <= self.days <= 90:
            raise ValueError("days out of range")
        if self.day is not None and self.now is not None and not 0 <= (self.now.date() - self.day).days <= KEPT_DAYS:
            raise ValueError("a day that isn't kept")
        if self.days is not None and self.now is None:
            raise ValueError("days need the time they count from")


def served(articles: DataFrame, sources: DataFrame, state: tuple[str, str] | None = None) -> DataFrame:
    """Articles whose source wants no takedown, and, given `state` (column, value), only those in that state; adds the
    source's name and language."""
    if state:
        articles = articles.where(F.col(state[0]) == state[1])
    shown = sources.where("takedown_requested_at is null").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("language").alias("source_language"))
    return articles.join(shown, "source_id")


def descendants(categories: DataFrame, slugs: list[str] | None = None) -> DataFrame:
    """(category_id, root_id) for every category and each of its ancestors, itself included, however deep the tree.

    Steps double: after k rounds all ancestors up to 2^k levels away are known. It ends when a round adds nothing, so a
    cycle ends as well.
    """
    nodes = categories.select("category_id", "parent_id").where("category_id is not null").distinct()
    own = nodes.select("category_id", F.col("category_id").alias("root_id"))
    closure = cut(own.unionByName(nodes.where("parent_id is not null").select("category_id", F.col("parent_id").alias("root_id"))).distinct())
    known = closure.count()
    while True:
        further = closure.join(closure.select(F.col("category_id").alias("root_id"), F.col("root_id").alias("up")), "root_id").select("category_id", F.col("up").alias("root_id"))
        closure = cut(closure.unionByName(further).distinct())
        n = closure.count()
        if n == known:
            break
        known = n
    if slugs is None:
        return closure
    wanted = categories.where(F.lower("slug").isin(slugs)).select(F.col("category_id").alias("root_id"))
    return closure.join(wanted, "root_id", "left_semi")


def sort_key(published: Column, created: Column) -> Column:
    """When an article counts as published: the stated moment, else when it was stored."""
    return F.coalesce(published, created)


def attributed(articles: DataFrame) -> DataFrame:
    """Articles with a url, a source name and a title that aren't blank."""
    return articles.where(" and ".join(f"trim({c}) <> ''" for c in ("url", "source_name", "title")))


def lookup(articles: DataFrame, ident: int) -> DataFrame:
    """The served article `ident`; no row where it isn't served or isn't there."""
    return articles.where(F.col("id") == ident)


def before(sort: Column, ident: Column, place: tuple[datetime, int]) -> Column:
    """Rows behind `place` in descending (sort, id) order."""
    stamp = F.lit(place[0]).cast("timestamp_ntz")
    return (sort < stamp) | ((sort == stamp) & (ident < place[1]))


def filtered(articles: DataFrame, request: FeedRequest, article_countries: DataFrame | None = None, countries: DataFrame | None = None, article_categories: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    out = articles
    sort = F.col("sort_ts")
    if request.countries:
        wanted = countries.where(F.lower("slug").isin(request.countries) | F.lower("iso2").isin(request.countries)).select("country_id")
        out = out.join(article_countries.join(wanted, "country_id", "left_semi").select(F.col("article_id").alias("id")), "id", "left_semi")
    if request.categories:
        tree = descendants(categories, request.categories).select("category_id")
        out = out.join(article_categories.join(tree, "category_id", "left_semi").select(F.col("article_id").alias("id")), "id", "left_semi")
    if request.language:
        out = out.where(F.col("source_language") == request.language.strip().lower())
    if request.sources:
        out = out.where(F.col("source_id").isin(request.sources))
    if request.day:
        first = datetime.combine(request.day, datetime.min.time())
        out = out.where((sort >= F.lit(first).cast("timestamp_ntz")) & (sort < F.lit(first + timedelta(days=1)).cast("timestamp_ntz")))
    if request.since:
        out = out.where(sort > F.lit(request.since).cast("timestamp_ntz"))
    if request.days:
        out = out.where(sort > F.lit(request.now - timedelta(days=request.days)).cast("timestamp_ntz"))
    if request.after:
        out = out.where(before(sort, F.col("id"), request.after))
    return out


def page(articles: DataFrame, limit: int) -> DataFrame:
    """The newest `limit` rows with their rank and whether more follow: one top-k of limit + 1."""
    top = articles.orderBy(F.desc_nulls_last("sort_ts"), F.desc("id")).limit(limit + 1)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("sort_ts"), F.desc("id"))))  # limit + 1 rows
    ranked = ranked.withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(1))) > limit)
    return ranked.where(F.col("rank") <= limit)


def next_place(ranked: DataFrame) -> DataFrame:
    """(has_more, next_cursor) of a page as it was ranked, before any interleaving: the cursor of its last row, null on the last page."""
    end = ranked.agg(F.coalesce(F.max("has_more"), F.lit(False)).alias("has_more"), F.max_by(F.struct("sort_ts", "id"), "rank").alias("last"))
    return end.select("has_more", F.when(F.col("has_more"), cursor(F.col("last.sort_ts"), F.col("last.id"))).alias("next_cursor"))


def interleaved(ranked: DataFrame) -> DataFrame:
    """A page in rounds: the newest article of each source, then the next of each; sources in order of appearance."""
    by = Window.partitionBy("source_id")
    rounds = ranked.withColumn("__round", F.row_number().over(by.orderBy("rank"))).withColumn("__first", F.min("rank").over(by))
    return rounds.withColumn("position", F.row_number().over(Window.orderBy("__round", "__first"))).drop("__round", "__first")  # one page


def counted_by(bridge: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    """(key, articles): bridge rows of served articles for each key."""
    ids = articles.select(F.col("id").alias("article_id"))
    return bridge.join(ids, "article_id", "left_semi").groupBy(key).agg(F.count("*").alias("articles"))


def rolled_up(direct: DataFrame, categories: DataFrame) -> DataFrame:
    """(category_id, articles): own count plus that of every enabled descendant; chains end at a disabled parent."""
    enabled = categories.where("is_enabled")
    tree = descendants(enabled.select("category_id", "parent_id", "slug"))
    kept = tree.join(enabled.select(F.col("category_id").alias("root_id")), "root_id", "left_semi")
    sums = kept.join(direct, "category_id", "left").groupBy(F.col("root_id").alias("category_id")).agg(F.sum(F.coalesce("articles", F.lit(0))).alias("articles"))
    return enabled.select("category_id", "slug").join(sums, "category_id")


def serialized(ranked: DataFrame, article_categories: DataFrame, categories: DataFrame) -> DataFrame:
    """Page rows with nested source and categories; dimensions join the page, never the whole table."""
    tags = ranked.select(F.col("id").alias("article_id")).join(article_categories, "article_id").join(categories.select("category_id", "slug"), "category_id")
    lists = tags.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_primary")).alias("second"), F.col("slug")))).alias("categories"))
    out = ranked.join(lists, ranked.id == lists.article_id, "left")
    return out.select("rank", "id", "title", F.struct(F.col("source_id").alias("id"), F.col("source_name").alias("name")).alias("source"), F.coalesce(F.transform("categories", lambda c: c["slug"]), F.array().cast("array<string>")).alias("categories"))
