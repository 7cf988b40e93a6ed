"""Queries of the feed, ingest, classification and monitoring operators, each with the SQL it is checked against."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions.urls import TRACKING, base_url, canonical_url, url_key
from newsloom.functions.vectors import vector_literal
from newsloom.operators import classify, feed, ingest, limits, similarity
from newsloom.plans.views import registry, view
from newsloom.session import table

QUERIES, ORACLES, query = registry()
NOW = datetime(2026, 3, 1, 12)


def _served(spark: SparkSession, d: str) -> DataFrame:
    return feed.served(view(spark, d, "v_articles"), table(spark, d, "sources"), ("ingest_status", "PUBLISHED"))


def _filtered(spark: SparkSession, d: str, **request) -> DataFrame:
    return feed.filtered(
        _served(spark, d), feed.FeedRequest(**request), view(spark, d, "v_article_countries"), view(spark, d, "v_countries"), view(spark, d, "v_article_categories"), view(spark, d, "v_categories")
    )


_SHOWN = "served AS (SELECT a.*, s.name AS source_name, s.language AS source_language FROM v_articles a JOIN sources s ON a.source_id = s.id WHERE s.takedown_requested_at IS NULL AND a.ingest_status = 'PUBLISHED')"
_PAGE = "page AS (SELECT *, row_number() OVER (ORDER BY sort_ts DESC, id DESC) AS rank FROM served)"


@query(f"WITH {_SHOWN} SELECT CAST(row_number() OVER (ORDER BY sort_ts DESC, id DESC) AS INT) AS rank, id, source_id, title, sort_ts FROM served ORDER BY sort_ts DESC, id DESC LIMIT 20")
def feed_page_latest(spark, d):
    return feed.page(_served(spark, d), 20).select("rank", "id", "source_id", "title", "sort_ts")


@query(
    f"""WITH {_SHOWN}, {_PAGE}, top AS (SELECT * FROM page WHERE rank <= 20),
    rounds AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY rank) AS r, min(rank) OVER (PARTITION BY source_id) AS f FROM top)
    SELECT CAST(row_number() OVER (ORDER BY r, f) AS INT) AS position, id, source_id FROM rounds"""
)
def feed_page_interleaved(spark, d):
    return feed.interleaved(feed.page(_served(spark, d), 20)).select("position", "id", "source_id")


@query(f"WITH {_SHOWN} SELECT id, source_id, sort_ts FROM served WHERE sort_ts < TIMESTAMP '2026-02-01 00:00:00' OR (sort_ts = TIMESTAMP '2026-02-01 00:00:00' AND id < 900) ORDER BY sort_ts DESC, id DESC LIMIT 20")
def feed_after_cursor(spark, d):
    return feed.page(_filtered(spark, d, after=(datetime(2026, 2, 1), 900)), 20).select("id", "source_id", "sort_ts")


@query("SELECT id, rtrim(replace(replace(to_base64(encode(strftime(sort_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(sort_ts) % 1000000 = 0 THEN '' ELSE strftime(sort_ts, '.%f') END || '|' || CAST(id AS VARCHAR))), '+', '-'), '/', '_'), '=') AS cursor, sort_ts AS stamp, id AS back FROM v_articles")
def feed_cursor_codec(spark, d):
    made = view(spark, d, "v_articles").select("id", tx.cursor(F.col("sort_ts"), F.col("id")).alias("cursor"))
    back = made.withColumn("x", tx.decoded_cursor(F.col("cursor")))
    return back.select("id", "cursor", F.col("x.stamp").alias("stamp"), F.col("x.id").alias("back"))


@query(f"WITH {_SHOWN} SELECT id FROM served s WHERE EXISTS (SELECT 1 FROM v_article_countries b JOIN v_countries c ON b.country_id = c.country_id WHERE b.article_id = s.id AND (lower(c.slug) IN ('tinubania-2', 'xd') OR lower(c.iso2) IN ('tinubania-2', 'xd')))")
def feed_by_country_semi(spark, d):
    return _filtered(spark, d, countries=feed.csv_values(" tinubania-2, XD ,")).select("id")


_TREE = "RECURSIVE tree AS (SELECT category_id FROM v_categories WHERE slug IN ('asia', 'peru') UNION ALL SELECT c.category_id FROM v_categories c JOIN tree t ON c.parent_id = t.category_id)"


@query(f"WITH {_TREE}, {_SHOWN} SELECT id FROM served s WHERE EXISTS (SELECT 1 FROM v_article_categories b JOIN tree t ON b.category_id = t.category_id WHERE b.article_id = s.id)")
def feed_by_category_tree(spark, d):
    return _filtered(spark, d, categories=["asia", "peru"]).select("id")


@query(f"WITH {_SHOWN} SELECT id, source_language FROM served WHERE source_language = 'fr'")
def feed_by_language(spark, d):
    return _filtered(spark, d, language=" FR ").select("id", "source_language")


@query(f"WITH {_SHOWN} SELECT id, source_id FROM served WHERE source_id IN (7, 15, 43)")
def feed_by_sources(spark, d):
    return _filtered(spark, d, sources=[7, 15, 43]).select("id", "source_id")


@query(f"WITH {_SHOWN} SELECT id, sort_ts FROM served WHERE sort_ts >= TIMESTAMP '2026-02-03' AND sort_ts < TIMESTAMP '2026-02-04'")
def feed_by_day(spark, d):
    return _filtered(spark, d, day=date(2026, 2, 3)).select("id", "sort_ts")


@query(f"WITH {_SHOWN} SELECT id, sort_ts FROM served WHERE sort_ts > TIMESTAMP '2026-02-20 06:00:00'")
def feed_since(spark, d):
    return _filtered(spark, d, since=datetime(2026, 2, 20, 6)).select("id", "sort_ts")


@query(f"WITH {_SHOWN} SELECT id, sort_ts FROM served WHERE sort_ts > TIMESTAMP '2026-03-01 12:00:00' - INTERVAL 30 DAY")
def feed_last_days(spark, d):
    return _filtered(spark, d, days=30, now=NOW).select("id", "sort_ts")


@query(
    f"""WITH {_TREE}, {_SHOWN} SELECT id FROM served s WHERE source_language IN ('en') AND sort_ts > TIMESTAMP '2025-10-01'
    AND EXISTS (SELECT 1 FROM v_article_categories b JOIN tree t ON b.category_id = t.category_id WHERE b.article_id = s.id)
    AND EXISTS (SELECT 1 FROM v_article_countries b JOIN v_countries c ON b.country_id = c.country_id WHERE b.article_id = s.id AND lower(c.iso2) IN ('xa', 'xb', 'xc'))"""
)
def feed_composed_filters(spark, d):
    return _filtered(spark, d, countries=["xa", "xb", "xc"], categories=["asia", "peru"], language="en", since=datetime(2025, 10, 1)).select("id")


@query(f"WITH {_SHOWN}, {_PAGE} SELECT count(DISTINCT source_id) AS publishers FROM page WHERE rank <= 20")
def feed_page_publishers(spark, d):
    return feed.page(_served(spark, d), 20).agg(F.count_distinct("source_id").alias("publishers"))


@query(f"WITH {_SHOWN} SELECT c.country_id, c.slug, count(*) AS articles FROM v_article_countries b JOIN served s ON b.article_id = s.id JOIN v_countries c ON b.country_id = c.country_id WHERE c.is_enabled GROUP BY ALL")
def country_counts(spark, d):
    counts = feed.counted_by(view(spark, d, "v_article_countries"), _served(spark, d), "country_id")
    return counts.join(view(spark, d, "v_countries").where("is_enabled"), "country_id").select("country_id", "slug", "articles")


@query(f"WITH {_SHOWN} SELECT b.category_id, count(*) AS articles FROM v_article_categories b JOIN served s ON b.article_id = s.id GROUP BY b.category_id")
def category_counts_direct(spark, d):
    return feed.counted_by(view(spark, d, "v_article_categories"), _served(spark, d), "category_id")


@query(
    f"""WITH RECURSIVE up AS (SELECT category_id, category_id AS root_id FROM v_categories WHERE is_enabled UNION ALL
        SELECT u.category_id, c.parent_id FROM up u JOIN v_categories c ON u.root_id = c.category_id JOIN v_categories p ON c.parent_id = p.category_id WHERE p.is_enabled),
    {_SHOWN}, direct AS (SELECT b.category_id, count(*) AS n FROM v_article_categories b JOIN served s ON b.article_id = s.id GROUP BY b.category_id)
    SELECT c.category_id, c.slug, CAST(sum(coalesce(n, 0)) AS BIGINT) AS articles FROM v_categories c JOIN up u ON u.root_id = c.category_id LEFT JOIN direct d ON d.category_id = u.category_id GROUP BY c.category_id, c.slug"""
)
def category_counts_rollup(spark, d):
    direct = feed.counted_by(view(spark, d, "v_article_categories"), _served(spark, d), "category_id")
    return feed.rolled_up(direct, view(spark, d, "v_categories")).select("category_id", "slug", "articles")


@query(f"WITH {_SHOWN} SELECT source_id, source_name, count(*) AS articles FROM served GROUP BY source_id, source_name ORDER BY articles DESC, source_name")
def source_counts(spark, d):
    return _served(spark, d).groupBy("source_id", "source_name").agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "source_name")


@query("SELECT source_language AS code, l.name, articles FROM (SELECT s.language AS source_language, count(*) AS articles FROM v_articles a JOIN sources s ON a.source_id = s.id WHERE s.takedown_requested_at IS NULL AND a.ingest_status = 'PUBLISHED' GROUP BY 1) x JOIN languages l ON l.code = x.source_language")
def language_reference(spark, d):
    counts = _served(spark, d).groupBy(F.col("source_language").alias("code")).agg(F.count("*").alias("articles"))
    return counts.join(table(spark, d, "languages").select("code", "name"), "code").select("code", "name", "articles")


@query(f"WITH {_SHOWN} SELECT CAST(CAST(sort_ts AS DATE) AS VARCHAR) AS day, count(*) AS articles FROM served GROUP BY 1")
def archive_window(spark, d):
    return _served(spark, d).groupBy(F.to_date("sort_ts").cast("string").alias("day")).agg(F.count("*").alias("articles"))


@query("SELECT coalesce(status, '') AS status, coalesce(enrichment_status, '') AS enrichment, count(*) AS n, grouping(status) AS g FROM v_articles GROUP BY GROUPING SETS ((status), (enrichment_status))")
def pipeline_stats_grouping(spark, d):
    a = view(spark, d, "v_articles")
    return spark.sql("SELECT coalesce(status, '') AS status, coalesce(enrichment_status, '') AS enrichment, count(*) AS n, CAST(grouping(status) AS BIGINT) AS g FROM {a} GROUP BY GROUPING SETS ((status), (enrichment_status))", a=a)


@query("SELECT id, CASE WHEN length(description) <= 80 THEN description ELSE regexp_replace(regexp_replace(substr(description, 1, 80), ' [^ ]*$', ''), '\\s+$', '') || '…' END AS excerpt FROM v_articles WHERE description IS NOT NULL")
def truncate_word_boundary(spark, d):
    return view(spark, d, "v_articles").where("description is not null").select("id", tx.truncated(F.col("description"), 80).alias("excerpt"))


_BARE = "regexp_replace(url, '[?#].*$', '')"
_CANON = f"""regexp_replace(CASE WHEN {_BARE} LIKE '%/' THEN regexp_replace({_BARE}, '/$', '') ELSE {_BARE} END, '^http:', 'https:')
    || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)=')), '&'), ''), '')"""


@query(f"SELECT id, {_CANON} AS canonical, sha256({_CANON}) AS url_key FROM v_articles WHERE url IS NOT NULL")
def url_canonical(spark, d):
    return view(spark, d, "v_articles").where("url is not null").select("id", canonical_url(F.col("url")).alias("canonical"), url_key(F.col("url")).alias("url_key"))


@query(f"SELECT url_key, min(id) AS id, count(*) AS copies FROM (SELECT id, sha256({_CANON}) AS url_key FROM v_articles WHERE trim(url) <> '') GROUP BY url_key")
def url_hash_dedup_keep_first(spark, d):
    rows = ingest.keyed(view(spark, d, "v_articles").select("id", "url")).select("url_key", "id")
    return ingest.first_of_each(rows, "url_key", ["id"], copies="copies")


@query("SELECT id, url_hash FROM v_articles WHERE url_hash IS NOT NULL AND sort_ts >= TIMESTAMP '2026-03-01' AND url_hash NOT IN (SELECT url_hash FROM v_articles WHERE url_hash IS NOT NULL AND sort_ts < TIMESTAMP '2026-03-01')")
def new_vs_existing_anti(spark, d):
    rows = view(spark, d, "v_articles").where("url_hash is not null").select("id", "url_hash", "sort_ts")
    edge = F.lit("2026-03-01").cast("timestamp_ntz")
    return ingest.unseen(rows.where(F.col("sort_ts") >= edge), rows.where(F.col("sort_ts") < edge), "url_hash").select("id", "url_hash")


@query("""WITH b AS (SELECT url_hash FROM v_articles WHERE url_hash IS NOT NULL AND sort_ts >= TIMESTAMP '2026-03-01'), k AS (SELECT DISTINCT url_hash FROM v_articles WHERE url_hash IS NOT NULL AND sort_ts < TIMESTAMP '2026-03-01')
    SELECT (SELECT count(*) FROM b) AS entries_seen, (SELECT count(DISTINCT url_hash) FROM b WHERE url_hash NOT IN (SELECT url_hash FROM k)) AS distinct_new, (SELECT count(*) FROM b) - (SELECT count(DISTINCT url_hash) FROM b WHERE url_hash NOT IN (SELECT url_hash FROM k)) AS duplicates""")
def ingest_counters(spark, d):
    rows = view(spark, d, "v_articles").where("url_hash is not null").select("url_hash", "sort_ts")
    edge = F.lit("2026-03-01").cast("timestamp_ntz")
    return ingest.counters(rows.where(F.col("sort_ts") >= edge), rows.where(F.col("sort_ts") < edge), "url_hash")


@query("SELECT url_hash, max_by(id, (updated_at, id)) AS id, max(updated_at) AS updated_at FROM v_articles WHERE url_hash IS NOT NULL AND updated_at IS NOT NULL GROUP BY url_hash")
def run_ledger_latest(spark, d):
    rows = view(spark, d, "v_articles").where("url_hash is not null and updated_at is not null").select("url_hash", "id", "updated_at")
    return ingest.latest(rows, "url_hash", ["updated_at", "id"])


@query("SELECT id, coalesce(nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug, regexp_extract(feed_url, '^([a-z]+://[^/]+)', 1) AS base FROM sources")
def publisher_slug(spark, d):
    return table(spark, d, "sources").select("id", tx.publisher_slug(F.col("name")).alias("slug"), base_url(F.col("feed_url")).alias("base"))


@query(
    """WITH n AS (SELECT id, 'The ' || name || ' World News' AS name FROM sources UNION ALL SELECT id + 1000, 'news live' FROM sources UNION ALL SELECT id + 2000, name FROM sources),
    w AS (SELECT id, list_filter(string_split(regexp_replace(regexp_replace(lower(name), '^(the|an|a) ', ''), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM n)
    SELECT id, array_to_string(CASE WHEN len(list_filter(words, lambda x: x NOT IN ('world','news','international','global','online','english','edition','uk','us','usa','digital','live','latest','headlines'))) > 0
        THEN list_filter(words, lambda x: x NOT IN ('world','news','international','global','online','english','edition','uk','us','usa','digital','live','latest','headlines')) ELSE words END, '-') AS identity FROM w"""
)
def publisher_identity(spark, d):
    s = table(spark, d, "sources").select("id", "name")
    names = s.select("id", F.concat(F.lit("The "), "name", F.lit(" World News")).alias("name")).unionByName(s.select((F.col("id") + 1000).alias("id"), F.lit("news live").alias("name"))).unionByName(s.select((F.col("id") + 2000).alias("id"), "name"))
    return names.select("id", tx.publisher_identity(F.col("name")).alias("identity"))


_FEEDS = "SELECT id, feed_url || CASE WHEN id % 4 = 0 THEN '/india/x.xml' WHEN id % 4 = 1 THEN '?section=uk' WHEN id % 4 = 2 THEN '/indianapolis/x' ELSE '' END AS feed_url FROM {s}"


@query(f"SELECT id, CASE WHEN id % 4 = 0 THEN 'IN' WHEN id % 4 = 1 THEN 'GB' END AS iso2 FROM ({_FEEDS.format(s='sources')})")
def section_country(spark, d):
    return spark.sql(_FEEDS, s=table(spark, d, "sources")).select("id", classify.section_country(F.col("feed_url")).alias("iso2"))


_PLAIN = [c for c in map(chr, range(0x21, 0x7F)) if c.isalnum() or c in ".-"]
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _PLAIN), "".join(_PLAIN)
_NORM = f"trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(replace(translate({{0}}, '{_WIDE[0]}', '{_WIDE[1]}'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '…', '...'))), '[^a-z0-9''.\\- ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalized(F.col("text")).alias("norm"))


_GAZ = f"""gaz AS (SELECT g.id AS alias_id, g.country_id, g.alias, g.weight, g.is_ambiguous, g.requires_context, {_NORM.format('g.alias')} AS surface FROM country_aliases g JOIN countries k ON g.country_id = k.id),
    pat AS (SELECT '\\b(?:' || string_agg(replace(surface, '.', '[.]'), '|' ORDER BY length(surface) DESC, surface) || ')\\b' AS p FROM (SELECT DISTINCT surface FROM gaz WHERE surface <> '')),
    tx AS (SELECT id, {_NORM.format("coalesce(title, '') || '. ' || coalesce(description, '')")} AS norm FROM v_texts),
    hit AS (SELECT DISTINCT id, norm, unnest(regexp_extract_all(norm, (SELECT p FROM pat))) AS surface FROM tx),
    ctx AS (SELECT alias_id, unnest(from_json(requires_context, '["VARCHAR"]')) AS c FROM gaz WHERE requires_context IS NOT NULL),
    m AS (SELECT h.id, g.alias_id, g.country_id, g.weight, g.is_ambiguous AND NOT EXISTS (SELECT 1 FROM ctx WHERE ctx.alias_id = g.alias_id AND regexp_matches(h.norm, '\\b' || replace(lower(c), '.', '[.]') || '\\b')) AS gated_out FROM hit h JOIN gaz g ON h.surface = g.surface)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_texts").select("id", F.concat_ws(". ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))).alias("text"))


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    """The stored aliases of known countries."""
    return table(spark, d, "country_aliases").join(table(spark, d, "countries").select(F.col("id").alias("country_id")), "country_id", "left_semi")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return classify.alias_matches(_texts(spark, d), _aliases(spark, d))


@query(f"WITH {_GAZ} SELECT id, alias_id, country_id, weight FROM m")
def gazetteer_matches(spark, d):
    return _matches(spark, d).select("id", "alias_id", "country_id", "weight")


@query(f"WITH {_GAZ} SELECT id, alias_id, country_id, weight, gated_out FROM m")
def gazetteer_matches_stored(spark, d):
    """The stored gazetteer over all texts; surfaces in other scripts fold to nothing and are left out."""
    return _matches(spark, d).select("id", "alias_id", "country_id", "weight", "gated_out")


@query("SELECT a.id, k.iso2, k.slug, a.alias, a.weight FROM country_aliases a JOIN countries k ON a.country_id = k.id WHERE k.is_enabled")
def gazetteer_scan(spark, d):
    countries = table(spark, d, "countries").where("is_enabled").select(F.col("id").alias("country_id"), "iso2", "slug")
    return table(spark, d, "country_aliases").join(countries, "country_id").select("id", "iso2", "slug", "alias", "weight")


@query(f"WITH {_GAZ} SELECT id, alias_id, gated_out FROM m")
def ambiguity_gate(spark, d):
    return _matches(spark, d).select("id", "alias_id", "gated_out")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    sources = spark.sql(f"SELECT id AS source_id, country AS source_country, x.feed_url FROM {{s}} JOIN ({_FEEDS.format(s='{s}')}) x USING (id)", s=table(spark, d, "sources"))
    places = view(spark, d, "v_texts").select("id", "source_id").join(sources, "source_id").select("id", "source_country", "feed_url")
    return classify.evidence(_matches(spark, d).where(~F.col("gated_out")), places, view(spark, d, "v_countries"), table(spark, d, "country_aliases").select("country_id"))


_SCORES = f"""{_GAZ}, known AS (SELECT DISTINCT upper(c.iso2) AS iso2 FROM v_countries c JOIN country_aliases a ON a.country_id = c.country_id),
    ev AS (SELECT m.id, c.iso2, 'alias' AS kind, m.weight FROM m JOIN v_countries c ON m.country_id = c.country_id WHERE NOT gated_out
    UNION ALL SELECT a.id, k.iso2, 'source', 0.65 FROM v_texts a JOIN sources s ON a.source_id = s.id JOIN known k ON k.iso2 = upper(trim(s.country))
    UNION ALL SELECT a.id, CASE WHEN a.source_id % 4 = 0 THEN 'IN' ELSE 'GB' END, 'section', 0.70 FROM v_texts a JOIN sources s ON a.source_id = s.id WHERE a.source_id % 4 IN (0, 1)),
    sc AS (SELECT id, iso2, round(sum(weight), 6) AS score, count(*) FILTER (kind = 'alias') AS matched, bool_or(kind = 'source') AS from_source, bool_or(kind = 'section') AS from_section FROM ev GROUP BY id, iso2)"""


@query(f"WITH {_SCORES} SELECT id, iso2, score, matched, from_source, from_section FROM sc")
def country_scores(spark, d):
    return classify.country_scores(_evidence(spark, d)).select("id", "iso2", "score", "matched", "from_source", "from_section")


_DECIDED = f"""{_SCORES}, rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, iso2) AS r, lead(score, 1, 0) OVER (PARTITION BY id ORDER BY score DESC, iso2) AS second, count(*) FILTER (score >= 0.5) OVER (PARTITION BY id) AS contenders FROM sc),
    top AS (SELECT * FROM rk WHERE r = 1),
    dec AS (SELECT a.id, CASE WHEN score >= 0.6 THEN iso2 END AS "primary",
        CASE WHEN score IS NULL THEN 0.0 WHEN score < 0.6 THEN round(score, 3) ELSE round(CASE WHEN from_source AND matched = 0 AND NOT from_section THEN least(0.35, least(1.0, score / 2 * 0.6 + least(score - second, 1.0) * 0.4)) ELSE least(1.0, score / 2 * 0.6 + least(score - second, 1.0) * 0.4) END, 3) END AS confidence,
        score IS NULL OR score < 0.6 OR contenders >= 3 AS is_international,
        CASE WHEN score IS NULL THEN false WHEN score < 0.6 THEN true ELSE score - second < 0.25 OR (from_source AND matched = 0 AND NOT from_section) END AS needs_review,
        CASE WHEN score IS NULL THEN 'none' WHEN score < 0.6 THEN 'gazetteer' WHEN from_section AND matched = 0 THEN 'section' WHEN from_source AND matched = 0 THEN 'source' ELSE 'gazetteer' END AS method FROM v_texts a LEFT JOIN top t ON a.id = t.id)"""


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return classify.country_decisions(view(spark, d, "v_texts").select("id"), classify.country_scores(_evidence(spark, d)))


@query(f'WITH {_DECIDED} SELECT id, "primary", confidence, is_international, needs_review, method FROM dec')
def country_decision(spark, d):
    return _decisions(spark, d).select("id", "primary", "confidence", "is_international", "needs_review", "method")


@query(f"""WITH {_DECIDED} SELECT dec.id AS article_id, "primary" AS label, 'primary' AS relevance, confidence FROM dec WHERE "primary" IS NOT NULL
    UNION ALL SELECT rk.id, iso2, CASE WHEN score >= 0.5 THEN 'secondary' ELSE 'mentioned' END, 0.0 FROM rk JOIN dec ON rk.id = dec.id WHERE r > 1 AND "primary" IS NOT NULL AND score > 0""")
def assignment_fanout(spark, d):
    return classify.fan_out(_decisions(spark, d))


@query(f'WITH {_DECIDED} SELECT count(*) AS processed, count("primary") AS assigned, count(*) FILTER (is_international) AS international, count(*) FILTER (needs_review) AS needs_review FROM dec')
def classification_stats(spark, d):
    return _decisions(spark, d).agg(F.count("*").alias("processed"), F.count("primary").alias("assigned"), F.count_if("is_international").alias("international"), F.count_if("needs_review").alias("needs_review"))


@query(f"""WITH {_DECIDED}, cases AS (SELECT a.id, nullif(upper(trim(s.country)), '') AS expect, s.category AS tag FROM v_texts a JOIN sources s ON a.source_id = s.id),
    e AS (SELECT tag, expect, "primary" AS p, cases.id % 5 = 0 AS allowed, coalesce(cases.id % 7 = 0 AND "primary" = 'IN', false) AS vetoed, CASE WHEN cases.id % 5 = 0 THEN coalesce("primary" = expect, false) OR coalesce("primary" = 'GB', false) ELSE expect IS NOT DISTINCT FROM "primary" END AS ok FROM cases JOIN dec ON cases.id = dec.id)
    SELECT tag, count(*) AS cases, count(*) FILTER (ok AND NOT vetoed) AS passed, count(*) FILTER (p IS NOT NULL AND (vetoed OR (expect IS NULL AND NOT allowed))) AS false_positives, count(*) FILTER (p IS NULL AND expect IS NOT NULL AND NOT allowed) AS misses FROM e GROUP BY tag""")
def eval_by_tag(spark, d):
    empty = F.array().cast("array<string>")
    sources = table(spark, d, "sources").select(F.col("id").alias("source_id"), F.nullif(F.upper(F.trim("country")), F.lit("")).alias("expect"), F.array("category").alias("tags"))
    allow, veto = F.when(F.col("id") % 5 == 0, F.array("expect", F.lit("GB"))).otherwise(empty), F.when(F.col("id") % 7 == 0, F.array(F.lit("IN"))).otherwise(empty)
    cases = view(spark, d, "v_texts").select("id", "source_id").join(sources, "source_id").select("id", "expect", "tags", allow.alias("allow"), veto.alias("must_not"))
    return classify.evaluated(cases, _decisions(spark, d))


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return classify.category_rules(view(spark, d, "v_categories"), view(spark, d, "v_keywords"))


_WORDS = "' ' || array_to_string(regexp_extract_all({0}, '[a-z0-9_]+'), ' ') || ' '"
_CATS = f"""rules AS (SELECT DISTINCT c.slug, p.slug AS parent, c.sort_order, k.keyword AS raw FROM v_categories c JOIN v_keywords k ON k.category_id = c.category_id LEFT JOIN v_categories p ON p.category_id = c.parent_id WHERE c.is_enabled AND trim(k.keyword) <> ''),
    kw AS (SELECT slug, parent, sort_order, {_WORDS.format(_NORM.format('raw'))} AS keyword FROM rules),
    n AS (SELECT id, {_WORDS.format(_NORM.format("coalesce(title, '')"))} AS t, {_WORDS.format(_NORM.format("coalesce(description, '')"))} AS d FROM v_texts),
    sc AS (SELECT id, slug, parent, sort_order, sum(CASE WHEN contains(t, keyword) THEN 1.0 ELSE 0.5 END) AS score FROM n JOIN kw ON trim(keyword) <> '' AND (contains(t, keyword) OR contains(d, keyword)) GROUP BY ALL)"""


@query(f"""WITH {_CATS} SELECT slug, parent, sort_order, count(*) AS keywords FROM (SELECT DISTINCT slug, parent, sort_order, raw FROM rules) GROUP BY ALL""")
def category_rules(spark, d):
    return _rules(spark, d).select("slug", "parent", "sort_order", F.size("keywords").cast("long").alias("keywords"))


@query(f"WITH {_CATS} SELECT id, slug, CAST(score AS DOUBLE) AS score FROM sc")
def category_scores(spark, d):
    return classify.keyword_scores(view(spark, d, "v_texts").select("id", "title", "description"), _rules(spark, d)).select("id", "slug", "score")


_CATEGORY = f"""{_CATS}, rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, sort_order, slug) AS r, first_value(score) OVER w AS ts, first_value(parent) OVER w AS tp FROM sc WINDOW w AS (PARTITION BY id ORDER BY score DESC, sort_order, slug)),
    second AS (SELECT id, list(slug ORDER BY r)[1:2] AS s FROM rk WHERE r > 1 AND score >= ts * 0.6 AND parent <> tp AND ts >= 1 GROUP BY id),
    dec AS (SELECT a.id, CASE WHEN score >= 1 THEN slug END AS "primary", CAST(CASE WHEN score IS NULL THEN 0 WHEN score < 1 THEN round(score, 2) ELSE round(least(1.0, CAST(score AS DOUBLE) / 3), 2) END AS DOUBLE) AS confidence, coalesce(array_to_string(second.s, ','), '') AS secondary,
        CASE WHEN score IS NULL OR score < 1 THEN true ELSE least(1.0, CAST(score AS DOUBLE) / 3) < 0.4 END AS needs_review FROM v_texts a LEFT JOIN (SELECT * FROM rk WHERE r = 1) t ON a.id = t.id LEFT JOIN second ON second.id = a.id)"""


@query(f'WITH {_CATEGORY} SELECT id, "primary", confidence, secondary, needs_review FROM dec')
def category_decision(spark, d):
    texts = view(spark, d, "v_texts").select("id", "title", "description")
    out = classify.category_decisions(texts.select("id"), classify.keyword_scores(texts, _rules(spark, d)))
    return out.select("id", "primary", "confidence", F.array_join("secondary", ",").alias("secondary"), "needs_review")


@query(f"""WITH {_CATEGORY}, f AS (SELECT id, "primary" AS slug, true AS is_primary, confidence FROM dec WHERE "primary" IS NOT NULL UNION ALL SELECT id, unnest(string_split(secondary, ',')), false, 0.0 FROM dec WHERE secondary <> '' AND "primary" IS NOT NULL)
    SELECT f.id AS article_id, c.category_id AS label_id, f.is_primary, f.confidence, t.created_at AS published_at FROM f JOIN v_categories c ON c.slug = f.slug JOIN cleaned_articles t ON t.id = f.id""")
def category_bridge(spark, d):
    texts = view(spark, d, "v_texts").select("id", "title", "description")
    decided = classify.category_decisions(texts.select("id"), classify.keyword_scores(texts, _rules(spark, d)))
    labels = view(spark, d, "v_categories").select(F.col("slug").alias("label"), F.col("category_id").alias("label_id"))
    return classify.bridge_rows(classify.fan_out(decided), labels, table(spark, d, "cleaned_articles").select(F.col("id").alias("article_id"), F.col("created_at").alias("published_at")))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_NEAR = """w AS (SELECT vec_id AS wid, embedding AS wv FROM embeddings ORDER BY vec_id DESC LIMIT 100),
    s AS (SELECT e.vec_id AS id, w.wid, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(w.wv AS DOUBLE[])), 6) AS c FROM embeddings e CROSS JOIN w WHERE e.vec_id NOT IN (SELECT wid FROM w))"""


@query(f"WITH {_NEAR} SELECT id, min(wid) AS nearest, round(max(c), 4) AS similarity, max(c) >= 0.35 AS is_duplicate FROM (SELECT *, max(c) OVER (PARTITION BY id) AS m FROM s) WHERE c = m GROUP BY id")
def near_duplicate_flags(spark, d):
    rows = _vectors(spark, d)
    window = similarity.latest_window(rows, [F.desc("id")])
    flags = similarity.window_duplicates(rows.join(F.broadcast(window.select("id")), "id", "left_anti"), window, 0.35)
    return flags.select("id", "nearest", F.round("similarity", 4).alias("similarity"), "is_duplicate")


@query("SELECT vec_id AS id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',') || ']' AS literal FROM embeddings")
def vector_literal_form(spark, d):
    return _vectors(spark, d).select("id", vector_literal(F.col("vector")).alias("literal"))


_FAILED = "NOT ok OR articles_returned = 0"
_RUNS = f"""i AS (SELECT *, {_FAILED} AS failed, sum(CASE WHEN {_FAILED} THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY checked_at, observation_id) AS island FROM v_health),
    r AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, island ORDER BY checked_at, observation_id) AS run FROM i)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "v_health").withColumn("failed", F.expr(_FAILED))
    return ingest.runs(rows, "source_id", ["checked_at", "observation_id"], "failed", F.to_date("checked_at"))


@query(f"WITH {_RUNS} SELECT observation_id, source_id, CAST(run AS BIGINT) AS consecutive_failures, run >= 3 AS warn, run >= 6 AS trips FROM r")
def breaker_runs(spark, d):
    n = F.col("consecutive_failures")
    return _runs(spark, d).select("observation_id", "source_id", n, (n >= 3).alias("warn"), (n >= 6).alias("trips"))


@query(f"WITH {_RUNS} SELECT source_id, CAST(arg_max(run, (checked_at, observation_id)) AS BIGINT) AS now_failing, CAST(max(run) AS BIGINT) AS longest FROM r GROUP BY source_id")
def failing_sources(spark, d):
    place = F.struct("checked_at", "observation_id")
    return _runs(spark, d).groupBy("source_id").agg(F.max_by("consecutive_failures", place).alias("now_failing"), F.max("consecutive_failures").alias("longest"))


@query("SELECT observation_id, NOT (NOT ok OR articles_returned = 0) AS ok, CASE WHEN ok AND articles_returned = 0 THEN 'empty_feed' END AS error_type FROM v_health")
def source_health_rows(spark, d):
    h = view(spark, d, "v_health")
    return h.select("observation_id", (~F.expr(_FAILED)).alias("ok"), F.when(F.col("ok") & (F.col("articles_returned") == 0), "empty_feed").alias("error_type"))


@query("""SELECT (SELECT count(*) FROM raw_articles WHERE raw_html IS NOT NULL AND created_at < TIMESTAMP '2026-03-01 12:00:00' - INTERVAL 24 HOUR) AS html_cleared,
    (SELECT count(*) FROM raw_articles WHERE created_at < TIMESTAMP '2026-03-01 12:00:00' - INTERVAL 10 DAY) AS articles, (SELECT count(*) FROM cleaned_articles WHERE raw_article_id IN (SELECT id FROM raw_articles WHERE created_at < TIMESTAMP '2026-03-01 12:00:00' - INTERVAL 10 DAY)) AS cleaned,
    (SELECT count(*) FROM article_embeddings WHERE raw_article_id IN (SELECT id FROM raw_articles WHERE created_at < TIMESTAMP '2026-03-01 12:00:00' - INTERVAL 10 DAY)) AS embeddings""")
def retention_counts(spark, d):
    raw = table(spark, d, "raw_articles")
    old = ingest.expired(raw, "created_at", "2026-03-01 12:00:00", "10 DAY").select("id")
    html = ingest.expired(raw.where("raw_html is not null"), "created_at", "2026-03-01 12:00:00", "24 HOUR").agg(F.count("*").alias("html_cleared"))
    count = lambda t: table(spark, d, t).join(old, F.col("raw_article_id") == old.id, "left_semi").agg(F.count("*")).scalar()
    return html.select("html_cleared", old.agg(F.count("*")).scalar().alias("articles"), count("cleaned_articles").alias("cleaned"), count("article_embeddings").alias("embeddings"))


@query("SELECT id, CASE WHEN raw_html IS NOT NULL AND created_at < TIMESTAMP '2026-02-28 12:00:00' THEN NULL ELSE md5(raw_html) END AS kept FROM raw_articles WHERE created_at >= TIMESTAMP '2026-02-19 12:00:00'")
def retention_kept(spark, d):
    """What retention keeps: one filter, so neither a shuffle nor the markup of rows that go."""
    raw = ingest.kept(table(spark, d, "raw_articles"), "created_at", "2026-03-01 12:00:00", "10 DAY")
    young = ~ingest.is_expired("created_at", "2026-03-01 12:00:00", "24 HOUR")
    return raw.select("id", F.when(young, F.md5(F.col("raw_html").cast("binary"))).alias("kept"))


_WANTED = "SELECT slug, CASE WHEN id % 5 = 0 THEN name || '!' ELSE name END AS name, sort_order FROM {c} WHERE id % 7 <> 0 UNION ALL SELECT 'new-' || slug, name, sort_order FROM {c} WHERE id % 9 = 0"


@query(f"WITH wanted AS ({_WANTED.format(c='countries')}) SELECT coalesce(s.slug, w.slug) AS slug, CASE WHEN s.slug IS NULL THEN 'created' WHEN w.slug IS NULL THEN 'orphan' WHEN s.name = w.name AND s.sort_order = w.sort_order THEN 'unchanged' ELSE 'updated' END AS change FROM countries s FULL JOIN wanted w ON s.slug = w.slug")
def seed_changeset(spark, d):
    c = table(spark, d, "countries")
    return ingest.change_set(c.select("slug", "name", "sort_order"), spark.sql(_WANTED, c=c), "slug")


_NTH = "e AS (SELECT event_id, user_id, ts, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL)"
_LEFT = "list_filter(s.kept, lambda x: x > e.ts - INTERVAL 6 HOUR)"


@query(
    f"""WITH RECURSIVE {_NTH}, s AS (SELECT user_id, n, event_id, [ts] AS kept, true AS accepted FROM e WHERE n = 1 UNION ALL
        SELECT e.user_id, e.n, e.event_id, CASE WHEN len({_LEFT}) >= 3 THEN {_LEFT} ELSE list_append({_LEFT}, e.ts) END, len({_LEFT}) < 3 FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, accepted FROM s"""
)
def rate_limiter_sliding(spark, d):
    return limits.sliding_window(table(spark, d, "events"), "user_id", "ts", "event_id", rate=3, window_s=6 * 3600)


_TOKENS = "least(CAST(3 AS DOUBLE), s.tokens + (e.t - s.last) * (CAST(1 AS DOUBLE) / 3600))"


@query(
    f"""WITH RECURSIVE {_NTH}, s AS (SELECT user_id, n, event_id, CAST(2 AS DOUBLE) AS tokens, t AS last, CAST(0 AS DOUBLE) AS wait_s FROM e WHERE n = 1 UNION ALL
        SELECT user_id, n, event_id, CASE WHEN k < 1 THEN CAST(0 AS DOUBLE) ELSE k - 1 END, CASE WHEN k < 1 THEN t + (1 - k) / (CAST(1 AS DOUBLE) / 3600) ELSE t END, CASE WHEN k < 1 THEN (1 - k) / (CAST(1 AS DOUBLE) / 3600) ELSE CAST(0 AS DOUBLE) END
        FROM (SELECT e.user_id, e.n, e.event_id, e.t, {_TOKENS} AS k FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
    SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, wait_s FROM s"""
)
def token_bucket_waits(spark, d):
    return limits.token_bucket(table(spark, d, "events"), "user_id", "ts", "event_id", rps=1 / 3600, burst=3)


@query()
def html_strip(spark, d):
    return view(spark, d, "v_articles").where("description is not null").select("id", tx.strip_html(F.col("description")).alias("plain"))


@query()
def clean_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.cleaned(F.col("text")).alias("cleaned"))


@query(
    """WITH p AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS t FROM (SELECT doc_id, list_transform(string_split(text, '. '), lambda s: regexp_replace(regexp_replace(s, '^[ \\t\\n\\x0B\\f\\r]+', ''), '[ \\t\\n\\x0B\\f\\r]+$', '')) AS x FROM documents)),
    f AS (SELECT doc_id, t, min(i) AS i FROM p WHERE length(t) >= 20 GROUP BY doc_id, t)
    SELECT d.doc_id, coalesce(string_agg(t, '. ' ORDER BY i), '') AS sentences FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id"""
)
def clean_sentences_distinct(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.distinct_sentences(F.col("text")).alias("sentences"))


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS INT) AS words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query("SELECT event_id, coalesce(nullif(regexp_replace(regexp_replace('```json' || chr(10) || props || chr(10) || '```', '^```(json)?\\s*', ''), '\\s*```$', ''), ''), '') AS bare FROM events WHERE props IS NOT NULL")
def json_fences(spark, d):
    e = table(spark, d, "events").where("props is not null")
    return e.select("event_id", tx.without_fences(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("bare"))


@query(f"""WITH {_SHOWN}, {_PAGE} SELECT p.id, p.title, p.source_id, p.source_name, coalesce((SELECT string_agg(c.slug, ',' ORDER BY b.is_primary DESC, c.slug) FROM v_article_categories b JOIN v_categories c ON b.category_id = c.category_id WHERE b.article_id = p.id), '') AS categories FROM page p WHERE rank <= 20""")
def article_serialized(spark, d):
    out = feed.serialized(feed.page(_served(spark, d), 20), view(spark, d, "v_article_categories"), view(spark, d, "v_categories"))
    return out.select("id", "title", F.col("source.id").alias("source_id"), F.col("source.name").alias("source_name"), F.array_join("categories", ",").alias("categories"))


@query("SELECT id, name FROM sources WHERE is_active AND takedown_requested_at IS NULL AND (contains(lower(name), 'wire') OR contains(lower(feed_url), 'sport'))")
def source_scan(spark, d):
    wanted = F.array(F.lit("wire"), F.lit("sport"))
    s = table(spark, d, "sources").where("is_active AND takedown_requested_at IS NULL")
    hit = F.exists(wanted, lambda w: F.contains(F.lower(s["name"]), w)) | F.exists(wanted, lambda w: F.contains(F.lower(s["feed_url"]), w))
    return s.where(hit).select("id", "name")


@query("SELECT x.source_id, s.name, x.articles, x.words FROM (SELECT r.source_id, count(*) AS articles, CAST(sum(c.word_count) AS BIGINT) AS words FROM raw_articles r JOIN cleaned_articles c ON c.raw_article_id = r.id GROUP BY 1 ORDER BY words DESC, 1 LIMIT 3) x JOIN sources s ON s.id = x.source_id")
def wordiest_sources(spark, d):
    """A top-k over a join: only the three groups that remain meet the dimension."""
    raw = table(spark, d, "raw_articles").select("id", "source_id")
    per = raw.join(table(spark, d, "cleaned_articles").select("raw_article_id", "word_count"), F.col("id") == F.col("raw_article_id")).groupBy("source_id").agg(F.count("*").alias("articles"), F.sum("word_count").alias("words"))
    top = per.orderBy(F.desc("words"), "source_id").limit(3)
    return top.join(table(spark, d, "sources").select(F.col("id").alias("source_id"), "name"), "source_id").select("source_id", "name", "articles", "words")


@query("SELECT a.id, coalesce(s.editorial_weight, 1.0) AS editorial_weight, coalesce(s.kind, 'rss') AS kind FROM v_articles a LEFT JOIN (SELECT * FROM sources WHERE id % 3 <> 0) s ON s.id = a.source_id")
def defaults_join(spark, d):
    dimension = table(spark, d, "sources").where("id % 3 <> 0").select(F.col("id").alias("source_id"), "editorial_weight", "kind")
    out = ingest.with_defaults(view(spark, d, "v_articles").select("id", "source_id"), dimension, "source_id", {"editorial_weight": 1.0, "kind": "rss"})
    return out.select("id", "editorial_weight", "kind")


@query("SELECT CAST(sum(octet_length(encode(coalesce(raw_html, ''))) + octet_length(encode(coalesce(summary_from_feed, '')))) AS BIGINT) AS used, printf('%.0f MB / %.0f MB (%.1f%%)', sum(octet_length(encode(coalesce(raw_html, ''))) + octet_length(encode(coalesce(summary_from_feed, '')))) / 1048576.0, 500.0, sum(octet_length(encode(coalesce(raw_html, ''))) + octet_length(encode(coalesce(summary_from_feed, '')))) * 100.0 / 524288000.0) AS shown FROM raw_articles")
def storage_used(spark, d):
    size = F.octet_length(F.coalesce("raw_html", F.lit(""))) + F.octet_length(F.coalesce("summary_from_feed", F.lit("")))
    used = table(spark, d, "raw_articles").agg(F.sum(size).alias("used"))
    return used.select("used", F.format_string("%.0f MB / %.0f MB (%.1f%%)", F.col("used") / 1048576.0, F.lit(500.0), F.col("used") * 100.0 / 524288000.0).alias("shown"))


@query("SELECT event_id, coalesce(nullif(trim(split_part(h, ',', 1)), ''), peer, 'unknown') AS client FROM (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE ' 10.0.' || CAST(user_id % 256 AS VARCHAR) || '.1 , 10.1.1.1' END AS h, CASE WHEN user_id % 2 = 0 THEN 'peer' || CAST(user_id AS VARCHAR) END AS peer FROM events)")
def client_key(spark, d):
    header = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit(" 10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1 , 10.1.1.1")))
    peer = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("peer"), F.col("user_id").cast("string")))
    return table(spark, d, "events").select("event_id", tx.client_key(header, peer).alias("client"))


_LABELS = "CASE WHEN event_id % 7 = 0 THEN 'not json' WHEN event_id % 5 = 0 THEN '{\"category\": \"Gossip\", \"confidence\": 0.9}' ELSE '{\"category\": \" ' || CASE WHEN event_id % 2 = 0 THEN 'Health' ELSE 'Sports' END || ' \", \"confidence\": 0.' || CAST(event_id % 10 AS {s}) || '}' END"
LABELS = "Politics Technology Business Science World Health Sports".split()


@query(f"""WITH r AS (SELECT event_id, {_LABELS.replace('{s}', 'VARCHAR')} AS response FROM events), p AS (SELECT event_id, trim(CASE WHEN json_valid(response) THEN json_extract_string(response, '$.category') END) AS category, CASE WHEN json_valid(response) THEN CAST(json_extract_string(response, '$.confidence') AS DOUBLE) END AS confidence FROM r)
    SELECT event_id, category IS NULL AS failed, CASE WHEN category IS NULL THEN NULL WHEN category NOT IN ('Politics','Technology','Business','Science','World','Health','Sports') OR confidence < 0.4 THEN 'Uncategorized' ELSE category END AS label,
    CASE WHEN category IS NULL THEN NULL WHEN category NOT IN ('Politics','Technology','Business','Science','World','Health','Sports') THEN 0.0 ELSE confidence END AS confidence FROM p""")
def response_labels(spark, d):
    """Labels out of recorded model responses: malformed ones fail, unknown or unsure ones are uncategorised."""
    r = table(spark, d, "events").select("event_id", F.expr(_LABELS.replace("{s}", "STRING")).alias("response"))
    x = F.from_json("response", "category string, confidence double")
    category, confidence = F.trim(x["category"]), x["confidence"]
    known = category.isin(LABELS)
    return r.select("event_id", category.isNull().alias("failed"), F.when(category.isNull(), None).when(~known | (confidence < 0.4), "Uncategorized").otherwise(category).alias("label"), F.when(category.isNull(), None).when(~known, 0.0).otherwise(confidence).alias("confidence"))


@query("SELECT DISTINCT url, CASE id % 5 WHEN 0 THEN NOT contains(url, '/sport/') WHEN 2 THEN true ELSE false END AS allowed FROM (SELECT id, url || CASE WHEN id % 2 = 0 THEN '/sport/x' ELSE '/news' END AS url FROM sources)")
def robots_decisions(spark, d):
    """Rules by host: read, forbidden, missing, out of order, and without an answer."""
    s = table(spark, d, "sources").select("id", F.concat("url", F.when(F.col("id") % 2 == 0, "/sport/x").otherwise("/news")).alias("url"))
    s = s.withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1))
    kind = F.col("id") % 5
    status = F.when(kind == 0, 200).when(kind == 1, 403).when(kind == 2, 404).when(kind == 3, 503)
    rules = s.where(kind != 4).select("host", status.alias("status"), F.when(kind == 0, "User-agent: *\nDisallow: /sport/").alias("body")).dropDuplicates(["host"])
    return ingest.allowed_by_robots(s.select("host", "url").distinct(), rules, "newsloom").select("url", "allowed")


_TRACKED = "SELECT id, 'http://news.example/' || CAST(id AS {t}) || '?a=1&' || {name} || '=x&b=' || CAST(id % 3 AS {t}) AS url FROM {r}"


@query(f"SELECT id, 'https://news.example/' || CAST(id AS VARCHAR) || '?a=1&b=' || CAST(id % 3 AS VARCHAR) AS canonical FROM raw_articles")
def url_canonical_tracking(spark, d):
    """Every tracking parameter goes, in capitals as well, and no other does."""
    names = F.array(*[F.lit(n.upper() if k % 2 else n) for k, n in enumerate(TRACKING)])
    r = table(spark, d, "raw_articles").select("id", F.element_at(names, (F.col("id") % len(TRACKING) + 1).cast("int")).alias("name"))
    urls = spark.sql(_TRACKED.format(t="STRING", name="name", r="{r}"), r=r)
    return urls.select("id", canonical_url(F.col("url")).alias("canonical"))


@query("SELECT id, slug, name FROM countries WHERE is_enabled ORDER BY sort_order, name")
def enabled_countries(spark, d):
    return table(spark, d, "countries").where("is_enabled").orderBy("sort_order", "name").select("id", "slug", "name")


@query("SELECT raw_article_id, id FROM (SELECT *, row_number() OVER (PARTITION BY raw_article_id ORDER BY created_at DESC, id DESC) AS r FROM cleaned_articles) WHERE r = 1")
def latest_cleaned(spark, d):
    return ingest.latest(table(spark, d, "cleaned_articles").select("raw_article_id", "id", "created_at"), "raw_article_id", ["created_at", "id"]).select("raw_article_id", "id")


@query("SELECT id FROM raw_articles WHERE id NOT IN (SELECT raw_article_id FROM cleaned_articles)")
def not_yet_cleaned(spark, d):
    return ingest.unseen(table(spark, d, "raw_articles").select("id"), table(spark, d, "cleaned_articles").select(F.col("raw_article_id").alias("id")), "id")
