"""Queries of sources, ingest bookkeeping and monitoring, each with the SQL it is checked against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators import classify, feed, ingest, monitor, providers, similarity
from newsloom.operators.timestamps import normalise_instants
from newsloom.plans.catalogue import _FAILED, _NEAR, _PAGE, _RUNS, _SHOWN, _runs, _served, _vectors
from newsloom.plans.views import registry, view
from newsloom.session import cut, shared_dir, table
from newsloom.sources import feeds
from newsloom.streaming import jobs

QUERIES, ORACLES, query = registry()

# Feeds

_CURSOR = "rtrim(replace(replace(to_base64(encode(strftime(sort_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(sort_ts) % 1000000 = 0 THEN '' ELSE strftime(sort_ts, '.%f') END || '|' || CAST(id AS VARCHAR))), '+', '-'), '/', '_'), '=')"


@query(f"WITH {_SHOWN}, {_PAGE} SELECT (SELECT count(*) > 20 FROM page) AS has_more, CASE WHEN (SELECT count(*) > 20 FROM page) THEN {_CURSOR} END AS next_cursor FROM page WHERE rank = least(20, (SELECT count(*) FROM page))")
def feed_next_cursor(spark, d):
    """The cursor of the page's last row in time, before interleaving."""
    return feed.next_place(feed.page(_served(spark, d), 20))


@query(f"WITH {_SHOWN} SELECT id, title, source_name FROM served WHERE id = (SELECT min(id) FROM served)")
def article_lookup(spark, d):
    rows = _served(spark, d)
    first = rows.agg(F.min("id")).first()[0]
    return feed.lookup(rows, -1 if first is None else first).select("id", "title", "source_name")


@query(f"WITH {_SHOWN} SELECT id FROM served WHERE trim(CASE WHEN id % 11 = 0 THEN ' ' ELSE url END) <> '' AND trim(source_name) <> '' AND trim(title) <> ''")
def attributed_articles(spark, d):
    rows = _served(spark, d).withColumn("url", F.when(F.col("id") % 11 == 0, " ").otherwise(F.col("url")))
    return feed.attributed(rows).select("id")


@query()
def feed_page_published(spark, d):
    """The newest page by the moments that feeds state in any format, else by the time of storing."""
    sources = table(spark, d, "sources").select(F.col("id").alias("source_id"), "tz", "date_order")
    raw = table(spark, d, "raw_articles").select("id", "source_id", "published_at").join(sources, "source_id", "left")
    stated = normalise_instants(raw, "published_at", "tz", "date_order").select("id", "published_us")
    moment = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("published_us").cast("decimal(20,0)") / 1000000).cast("decimal(18,6)"))
    rows = _served(spark, d).join(stated, "id", "left").withColumn("sort_ts", feed.sort_key(moment, F.col("created_at")))
    return feed.page(rows, 20).select("rank", "id", "sort_ts")


@query("SELECT a.id, a.title FROM v_articles a WHERE a.id IN (SELECT raw_article_id FROM article_embeddings)")
def batched_lookup(spark, d):
    """Rows of many ids at once: one semi-join, whatever their number."""
    wanted = table(spark, d, "article_embeddings").select(F.col("raw_article_id").alias("id"))
    return view(spark, d, "v_articles").select("id", "title").join(wanted, "id", "left_semi")


# Sources

_XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """One document for each source, in its kind's format: two entries made of its own row."""
    rss = f"'<rss><channel><item><title>' || {_XML.format('name')} || '</title><link>' || url || '/a?x=1</link><description>' || {_XML.format('category')} || '</description></item><item><title> </title><link>' || url || '</link></item><item><title>Second</title><link>' || url || '/b</link></item></channel></rss>'"
    entry = "to_json(struct(array(named_struct('title', name, 'url', url || '/a', 'description', category, 'publishedAt', '2026-01-0' || CAST(id % 9 + 1 AS STRING) || 'T10:00:00+02:00', 'source', named_struct('name', name, 'url', url)), named_struct('title', 'No publisher', 'url', url, 'description', '', 'publishedAt', 'yesterday', 'source', named_struct('name', ' ', 'url', url))) AS articles))"
    return spark.sql(f"SELECT id, kind, CASE WHEN kind = 'gnews' THEN {entry} ELSE {rss} END AS body FROM {{s}} WHERE name IS NOT NULL AND url IS NOT NULL AND category IS NOT NULL", s=table(spark, d, "sources"))


def _rss(documents: DataFrame) -> DataFrame:
    return feeds.parse_feeds(documents, "id", "body").select(F.col("feed").cast("long").alias("source_id"), "title", "url", "summary", F.lit(None).cast("timestamp_ntz").alias("published"), F.lit(None).cast("string").alias("publisher"))


def _aggregator(documents: DataFrame) -> DataFrame:
    flat = feeds.flatten_aggregator(documents, "body")
    return flat.select(F.lit(None).cast("long").alias("source_id"), "title", "url", F.col("description").alias("summary"), feeds.published_utc(F.col("published")).alias("published"), "publisher")


_KNOWN = "SELECT * FROM sources WHERE name IS NOT NULL AND url IS NOT NULL AND category IS NOT NULL"


@query(f"""WITH k AS ({_KNOWN}) SELECT id AS source_id, name AS title, url || '/a?x=1' AS url, category AS summary FROM k WHERE coalesce(kind, 'rss') <> 'gnews' UNION ALL SELECT id, 'Second', url || '/b', NULL FROM k WHERE coalesce(kind, 'rss') <> 'gnews'""")
def feed_entries(spark, d):
    """Feed documents, written from the sources' rows, read back as entries."""
    return _rss(_documents(spark, d).where("coalesce(kind, 'rss') <> 'gnews'")).select("source_id", "title", "url", "summary")


@query(f"WITH k AS ({_KNOWN}) SELECT name AS title, url || '/a' AS url, category AS summary, CAST('2026-01-0' || CAST(id % 9 + 1 AS VARCHAR) || ' 08:00:00' AS TIMESTAMP) AS published, name AS publisher FROM k WHERE kind = 'gnews'")
def aggregator_entries(spark, d):
    return _aggregator(_documents(spark, d).where("kind = 'gnews'")).select("title", "url", "summary", "published", "publisher")


@query(f"""WITH k AS ({_KNOWN}) SELECT name AS title, url || CASE WHEN kind = 'gnews' THEN '/a' ELSE '/a?x=1' END AS url FROM k UNION ALL SELECT 'Second', url || '/b' FROM k WHERE coalesce(kind, 'rss') <> 'gnews'""")
def entries_by_kind(spark, d):
    """All documents, each read by the reader of its source's kind."""
    return feeds.read_by_kind(_documents(spark, d), {"rss": _rss, "gnews": _aggregator}).select("title", "url")


@query("SELECT * FROM (VALUES (1, TIMESTAMP '2026-03-29 00:30:00'), (2, TIMESTAMP '2026-03-29 00:30:00'), (3, TIMESTAMP '2026-03-29 02:30:00.25'), (4, NULL), (5, NULL), (6, TIMESTAMP '2026-03-29 00:00:00'), (7, NULL)) t(id, published)")
def aggregator_times(spark, d):
    rows = [(1, "2026-03-29T00:30:00Z"), (2, "2026-03-29T02:30:00+02:00"), (3, "2026-03-29 02:30:00.25"), (4, "yesterday"), (5, None), (6, "2026-03-29"), (7, "2026-02-30T00:00:00Z")]
    return spark.createDataFrame(rows, "id int, s string").select("id", feeds.published_utc(F.col("s")).alias("published"))


@query("SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE (SELECT string_agg('w' || CAST((r.id * 7 + i) % 1000 AS VARCHAR), ' ' ORDER BY i) FROM generate_series(1, 60) g(i)) END AS body FROM raw_articles r")
def page_bodies(spark, d):
    """Bodies of pages made of the articles' ids: inside an article element, as loose paragraphs, and too short."""
    words = "array_join(transform(sequence(1, {0}), i -> concat('w', CAST((id * 7 + i) % 1000 AS STRING))), ' ')"
    page = f"CASE WHEN id % 3 = 0 THEN concat('<nav><p>Menu</p></nav><article><p>', {words.format(60)}, '</p></article><p>Teaser</p>') WHEN id % 3 = 1 THEN concat('<header><p>Top</p></header><p>', {words.format(60)}, '</p><script>x</script>') ELSE concat('<p>', {words.format(20)}, '</p>') END"
    pages = spark.sql(f"SELECT id, {page} AS html FROM {{r}}", r=table(spark, d, "raw_articles"))
    return feeds.page_bodies(pages, "id", "html", most_chars=feeds.MOST_CHARS)


# Markup and cleaning, on rows whose result is known

_MARKUP = [
    (1, "<p>One <b>bold</b> word.</p><p>Two</p>", "One bold word. Two"), (2, "plain &amp; simple", "plain & simple"), (3, "<script>no</script>Yes<br/>there", "Yes — there"), (4, "", ""),
    (5, "<ul><li>a</li><li>b</li></ul>", "a — b"),
]


@query("SELECT * FROM (VALUES (1, 'One bold word. Two'), (2, 'plain & simple'), (3, 'Yes — there'), (4, ''), (5, 'a — b')) t(id, plain)")
def html_strip_known(spark, d):
    return spark.createDataFrame([r[:2] for r in _MARKUP], "id int, s string").select("id", tx.strip_html(F.col("s")).alias("plain"))


_DIRTY = [
    (1, "  Said on Monday\u00a0by the council &amp; all.  See https://e.x/a?b=1 now. "), (2, "The same long sentence stands here. The same long sentence stands here. Another long sentence follows it."), (3, "“Quoted” — text that is long enough"), (4, ""),
]


@query("SELECT * FROM (VALUES (1, 'Said on Monday by the council & all'), (2, 'The same long sentence stands here. Another long sentence follows it.'), (3, '\"Quoted\"  -  text that is long enough'), (4, '')) t(id, cleaned)")
def clean_text_known(spark, d):
    return spark.createDataFrame(_DIRTY, "id int, s string").select("id", tx.cleaned(F.col("s")).alias("cleaned"))


# Publishers

_IDENTITY = """w AS (SELECT name, list_filter(string_split(regexp_replace(regexp_replace(trim(lower(name)), '^(the|an|a) ', ''), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM (SELECT name FROM sources UNION SELECT name FROM wanted)),
    ident AS (SELECT DISTINCT name, coalesce(nullif(array_to_string(CASE WHEN len(list_filter(words, lambda x: x NOT IN ('world','news','international','global','online','english','edition','uk','us','usa','digital','live','latest','headlines'))) > 0
        THEN list_filter(words, lambda x: x NOT IN ('world','news','international','global','online','english','edition','uk','us','usa','digital','live','latest','headlines')) ELSE words END, '-'), ''), 'unknown') AS who FROM w)"""
_WANTED = "SELECT name FROM {s} UNION SELECT 'The ' || name || ' World News' FROM {s} UNION SELECT 'Nobody ' || CAST(id AS {t}) FROM {s} WHERE id % 10 = 0 UNION SELECT '  ' FROM {s}"


@query(f"""WITH wanted AS ({_WANTED.format(s='sources', t='VARCHAR')}), {_IDENTITY},
    x AS (SELECT w.name, (SELECT min(s.id) FROM sources s WHERE s.feed_url = 'gnews://' || coalesce(nullif(trim(regexp_replace(lower(w.name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown')) AS exact,
        (SELECT min(s.id) FROM sources s JOIN ident a ON a.name = s.name JOIN ident b ON b.name = w.name AND a.who = b.who WHERE coalesce(s.kind, 'rss') <> 'discovered' OR s.name = w.name) AS alike FROM wanted w WHERE trim(w.name) <> '')
    SELECT name, coalesce(exact, alike) AS source_id FROM x""")
def publisher_resolution(spark, d):
    s = table(spark, d, "sources")
    return ingest.resolved_publishers(spark.sql(_WANTED.format(s="{s}", t="STRING"), s=s), s.select("id", "name", "feed_url", "kind"))


_NAMED = "CASE WHEN a.id % 4 = 1 THEN a.source_id % 100 + 1 END"


@query(f"SELECT a.id, coalesce((SELECT min(s.id) FROM sources s JOIN sources n ON s.name = n.name WHERE n.id = {_NAMED}), a.source_id) AS filed_under, {_NAMED} AS named FROM v_articles a WHERE trim(a.url) <> '' AND a.id % 4 <> 2")
def owned_entries(spark, d):
    """Aggregator entries filed under the publisher they name; unknown publishers are dropped."""
    s = table(spark, d, "sources").select("id", "name", "feed_url", "kind")
    named = F.when(F.col("id") % 4 == 1, F.col("source_id") % 100 + 1)
    rows = view(spark, d, "v_articles").select("id", "source_id", "url").withColumn("named", named)
    rows = rows.join(s.select(F.col("id").alias("named"), F.col("name").alias("publisher")), "named", "left")
    rows = rows.withColumn("publisher", F.when(F.col("id") % 4 == 2, F.lit("Nobody at all")).otherwise(F.col("publisher")))
    return ingest.owned(rows, s).select("id", F.col("source_id").alias("filed_under"), "named")


# Bookkeeping


@query("SELECT id, CASE WHEN id = min(id) OVER (PARTITION BY url_hash) THEN url_hash END AS url_hash FROM raw_articles")
def url_hash_backfill(spark, d):
    return ingest.backfilled_keys(table(spark, d, "raw_articles"), "id", "url_hash")


@query("SELECT c.slug, p.category_id AS parent_id FROM v_categories c LEFT JOIN v_categories q ON q.category_id = c.parent_id LEFT JOIN v_categories p ON p.slug = q.slug")
def category_parents(spark, d):
    c = view(spark, d, "v_categories")
    named = c.join(c.select(F.col("category_id").alias("parent_id"), F.col("slug").alias("parent")), "parent_id", "left").select("category_id", "slug", "parent")
    return ingest.with_parent_ids(named, "category_id", "slug", "parent").select("slug", "parent_id")


@query("SELECT country_id, alias FROM country_aliases WHERE country_id % 3 <> 0 UNION ALL SELECT id, 'only ' || name FROM countries WHERE id % 3 = 0")
def aliases_replaced(spark, d):
    """The aliases of a seed file's countries exchanged as a whole."""
    batch = table(spark, d, "countries").where("id % 3 = 0").select(F.col("id").alias("country_id"), F.concat(F.lit("only "), "name").alias("alias"))
    return ingest.replaced(table(spark, d, "country_aliases").select("country_id", "alias"), batch, "country_id")


@query("SELECT article_id, category_id FROM v_article_categories WHERE article_id % 10 <> 0 UNION ALL SELECT id, CAST(1 AS BIGINT) FROM raw_articles WHERE id % 10 = 0")
def bridge_replaced(spark, d):
    batch = table(spark, d, "raw_articles").where("id % 10 = 0").select(F.col("id").alias("article_id"), F.lit(1).cast("long").alias("category_id"))
    return ingest.replaced(view(spark, d, "v_article_categories").select("article_id", "category_id"), batch, "article_id")


@query("SELECT id, name FROM sources WHERE (SELECT count(*) FROM sources WHERE id < 0) = 0 AND kind = 'gnews'")
def seeded_sources(spark, d):
    s = table(spark, d, "sources")
    return ingest.seeded_if_empty(s.where("id < 0"), s.where("kind = 'gnews'").select("id", "name"))


@query("SELECT 'https://demo.invalid/' || CAST(m AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS url, sha256('https://demo.invalid/' || CAST(m AS VARCHAR) || '-' || CAST(i AS VARCHAR)) AS url_key, 'Synthetic fixture article ' || CAST(m AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS title, TIMESTAMP '2026-03-01 12:00:00' - to_minutes(CAST(i AS BIGINT)) AS published_at FROM generate_series(0, 499) g(i), (SELECT max(id) AS m FROM raw_articles)")
def synthetic_backlog(spark, d):
    last = table(spark, d, "raw_articles").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return ingest.synthetic_backlog(spark, 500, "2026-03-01 12:00:00", last)


@query("""WITH k AS (SELECT url_hash, min(id) AS id FROM v_articles WHERE url_hash IS NOT NULL AND created_at >= TIMESTAMP '2026-02-01' GROUP BY url_hash), n AS (SELECT * FROM k WHERE url_hash NOT IN (SELECT url_hash FROM v_articles WHERE url_hash IS NOT NULL AND created_at < TIMESTAMP '2026-02-01'))
    SELECT url_hash, id FROM n ORDER BY id LIMIT 50""")
def fresh_limited(spark, d):
    """The first fifty new articles of a batch."""
    rows = view(spark, d, "v_articles").where("url_hash is not null").select("url_hash", "id", "created_at")
    edge = F.lit("2026-02-01").cast("timestamp_ntz")
    return ingest.fresh(rows.where(F.col("created_at") >= edge).select("url_hash", "id"), rows.where(F.col("created_at") < edge), "url_hash", ["id"], 50)


_EVENTS = "SELECT user_id AS run_id, CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'purchase' THEN 'end' ELSE 'error' END AS kind, ts AS happened, event_id % 50 AS entries_seen, event_id % 7 AS entries_new, 'e' || CAST(event_id AS {t}) AS error FROM {e}"


@query(f"""WITH e AS ({_EVENTS.format(t='VARCHAR', e='events')}), r AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY happened, error) AS n FROM e)
    SELECT run_id, CASE WHEN count(*) FILTER (kind = 'end') = 0 THEN 'running' WHEN count(*) FILTER (kind = 'error') > 0 THEN 'partial' ELSE 'success' END AS status, min(happened) FILTER (kind = 'start') AS started_at, coalesce(max(entries_seen) FILTER (kind = 'end'), 0) AS entries_seen, coalesce(max(entries_new) FILTER (kind = 'end'), 0) AS entries_new,
    count(*) FILTER (kind = 'error') AS failures, coalesce(string_agg(error, ',' ORDER BY happened, error) FILTER (kind = 'error' AND n <= 20), '') AS errors FROM r GROUP BY run_id""")
def run_ledger(spark, d):
    events = spark.sql(_EVENTS.format(t="STRING", e="{e}"), e=table(spark, d, "events"))
    return monitor.run_ledger(events.withColumnRenamed("happened", "at")).select("run_id", "status", "started_at", "entries_seen", "entries_new", "failures", F.array_join("errors", ",").alias("errors"))


@query("SELECT id, left(trim(title), 1024) AS stored, left(coalesce(summary_from_feed, ''), 40) AS prompt, trim(coalesce(title, '') || ' ' || coalesce(summary_from_feed, '')) AS embedded FROM raw_articles")
def stored_slices(spark, d):
    """What is stored of a title, sent of a summary and embedded of an article."""
    r = table(spark, d, "raw_articles")
    return r.select("id", tx.stored_title(F.col("title")).alias("stored"), tx.token_slice(F.col("summary_from_feed"), 10).alias("prompt"), similarity.embed_text(F.col("title"), F.col("summary_from_feed")).alias("embedded"))


@query(f"WITH {_NEAR}, b AS (SELECT id, max(c) >= 0.35 AS dup FROM s GROUP BY id) SELECT count(*) FILTER (NOT dup) AS \"unique\", count(*) FILTER (dup) AS duplicates, (SELECT count(*) FROM embeddings WHERE vec_id < 0) AS failed FROM b")
def duplicate_counters(spark, d):
    rows = _vectors(spark, d)
    window = similarity.latest_window(rows, [F.desc("id")])
    return similarity.result_counters(similarity.window_duplicates(rows.join(window.select("id"), "id", "left_anti"), window, 0.35))


# Monitoring


@query("SELECT backlog, CAST(greatest(1, least(8, ceil(backlog / 20.0))) AS INT) AS workers FROM (SELECT count(*) AS backlog FROM raw_articles WHERE enrichment_status = 'PENDING' AND ingest_status = 'PUBLISHED')")
def backlog_workers(spark, d):
    n = table(spark, d, "raw_articles").agg(F.count_if((F.col("enrichment_status") == "PENDING") & (F.col("ingest_status") == "PUBLISHED")).alias("backlog"))
    return n.select("backlog", monitor.wanted_workers(F.col("backlog")).alias("workers"))


@query("SELECT id FROM raw_articles WHERE enrichment_status = 'PENDING' AND ingest_status = 'PUBLISHED' AND id IN (SELECT raw_article_id FROM cleaned_articles) ORDER BY id LIMIT 5")
def queue_batch(spark, d):
    pending = table(spark, d, "raw_articles").where("enrichment_status = 'PENDING' and ingest_status = 'PUBLISHED'").select("id")
    return monitor.queue_batch(pending, table(spark, d, "cleaned_articles"))


@query(f"WITH {_RUNS}, n AS (SELECT source_id, CAST(arg_max(run, (checked_at, observation_id)) AS BIGINT) AS now_failing FROM r GROUP BY source_id) SELECT source_id, now_failing FROM n WHERE now_failing >= 1 ORDER BY now_failing DESC, source_id")
def failing_now(spark, d):
    """Sources that fail now, worst first (a threshold of one, as longer runs are rare here)."""
    return monitor.failing(_runs(spark, d), 1)


@query("SELECT source_id, used, used * 100.0 / 20000 AS percent, used * 100.0 / 20000 >= 70 AS warn, used * 100.0 / 20000 >= 90 AS stop FROM (SELECT source_id, CAST(sum(octet_length(encode(coalesce(summary_from_feed, '')))) AS BIGINT) AS used FROM raw_articles GROUP BY source_id)")
def storage_decisions(spark, d):
    used = table(spark, d, "raw_articles").groupBy("source_id").agg(F.sum(F.octet_length(F.coalesce("summary_from_feed", F.lit("")))).alias("used"))
    return used.withColumn("s", monitor.storage_decision(F.col("used"), 20000)).select("source_id", "used", "s.percent", "s.warn", "s.stop")


@query("SELECT count(*) AS claimed, count(*) FILTER (enrichment_status = 'DONE') AS summarized, count(*) FILTER (enrichment_status = 'FAILED') AS failed, count(*) FILTER (enrichment_status = 'SKIPPED') AS skipped FROM raw_articles WHERE enrichment_status <> 'PENDING'")
def worker_counters(spark, d):
    return monitor.worker_counters(table(spark, d, "raw_articles").where("enrichment_status <> 'PENDING'").select(F.col("enrichment_status").alias("outcome")))


@query("SELECT count(*) = 0 AS is_empty, count(*) AS n, max(id) AS last_id FROM raw_articles")
def table_state(spark, d):
    return table(spark, d, "raw_articles").agg((F.count("*") == 0).alias("is_empty"), F.count("*").alias("n"), F.max("id").alias("last_id"))


@query("SELECT user_id % 50 AS url_id, arg_max(event_id, ts) AS etag FROM events WHERE event_type <> 'error' GROUP BY 1")
def header_cache(spark, d):
    e = table(spark, d, "events")
    answers = e.select((F.col("user_id") % 50).cast("string").alias("url"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"), F.col("event_id").cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    return monitor.header_cache(answers).select(F.col("url").cast("long").alias("url_id"), F.col("etag").cast("long").alias("etag"))


_RESPONSES = "CASE WHEN event_id % 7 = 0 THEN 'no json' WHEN event_id % 5 = 0 THEN '{\"tldr\": \"Insufficient content here\", \"bullets\": [\"a\"]}' WHEN event_id % 3 = 0 THEN '{\"tldr\": \" ok \", \"bullets\": []}' ELSE '{\"tldr\": \" Said ' || CAST(event_id AS {s}) || ' \", \"bullets\": [\" one \", \"\", \"two\"]}' END"


@query("SELECT event_id, event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 3 = 0 AS failed, CASE WHEN NOT (event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 3 = 0) THEN 'Said ' || CAST(event_id AS VARCHAR) END AS tldr, CASE WHEN NOT (event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 3 = 0) THEN 'one,two' END AS bullets FROM events")
def summary_responses(spark, d):
    r = table(spark, d, "events").select("event_id", F.expr(_RESPONSES.replace("{s}", "STRING")).alias("response"))
    return providers.summaries(r, "event_id", "response").select("event_id", "failed", "tldr", F.array_join("bullets", ",").alias("bullets"))


@query("SELECT id, CASE WHEN regexp_matches(feed_url, '/xk/') THEN 'XK' WHEN id % 2 = 0 THEN 'IN' END AS iso2 FROM (SELECT id, feed_url || CASE WHEN id % 3 = 0 THEN '/xk/rss' WHEN id % 2 = 0 THEN '/india' ELSE '' END AS feed_url FROM sources)")
def section_country_codes(spark, d):
    """Sections that name a country by name or by one of the stored codes."""
    codes = [r[0] for r in table(spark, d, "countries").select("iso2").where("iso2 is not null").distinct().collect()]  # a table of settings
    s = spark.sql("SELECT id, feed_url || CASE WHEN id % 3 = 0 THEN '/xk/rss' WHEN id % 2 = 0 THEN '/india' ELSE '' END AS feed_url FROM {s}", s=table(spark, d, "sources"))
    return s.select("id", classify.section_country(F.col("feed_url"), codes).alias("iso2"))


# Streams, run to their end over what is there


@query(f"WITH {_RUNS} SELECT observation_id, source_id, CAST(run AS BIGINT) AS consecutive_failures, run >= 3 AS warn, run >= 6 AS trips FROM r")
def breaker_stream(spark, d):
    """The stateful stream over all observations gives what the window query gives."""
    base = f"{shared_dir(spark)}/breaker-{uuid.uuid4().hex}"
    rows = view(spark, d, "v_health").select("source_id", "observation_id", "checked_at", F.expr(_FAILED).alias("failed"))
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    out = jobs.breaker_stream(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    return cut(spark.read.schema("source_id long, observation_id long, consecutive_failures long, warn boolean, trips boolean").parquet(f"{base}/out"))


@query("SELECT DISTINCT name AS title, url || '/a?x=1' AS url FROM sources WHERE name IS NOT NULL AND url IS NOT NULL AND category IS NOT NULL AND coalesce(kind, 'rss') <> 'gnews' UNION ALL SELECT 'Second', url || '/b' FROM (SELECT DISTINCT url FROM sources WHERE name IS NOT NULL AND url IS NOT NULL AND category IS NOT NULL AND coalesce(kind, 'rss') <> 'gnews')")
def ingest_stream(spark, d):
    """Feed files that land are read once, whatever copies come after them."""
    base = f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    docs = _documents(spark, d).where("coalesce(kind, 'rss') <> 'gnews'").select("body")
    for _ in range(2):  # all files twice
        docs.repartition(8).write.mode("append").option("lineSep", "\n").text(f"{base}/in")
        jobs.ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/state", whole=False).awaitTermination()
    return spark.read.schema(jobs.STORED).parquet(f"{base}/out").select("title", F.col("canonical_url").alias("url"))
