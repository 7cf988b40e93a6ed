"""Adapter views: the shapes that feed and classification operators need, derived from the test tables.

Each is one SELECT in the SQL that Spark and DuckDB share, so a query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.session import table

SQL = {
    "v_articles": "SELECT id, source_id, url, url_hash, title, summary_from_feed AS description, status, ingest_status, enrichment_status, coalesce(CASE WHEN published_at LIKE '____-__-__T__:__:__Z' THEN TRY_CAST(replace(replace(published_at, 'T', ' '), 'Z', '') AS TIMESTAMP) END, created_at) AS sort_ts, created_at, updated_at FROM raw_articles",
    "v_categories": """SELECT CAST(100 + r_regionkey AS BIGINT) AS category_id, CAST(NULL AS BIGINT) AS parent_id, lower(replace(r_name, ' ', '-')) AS slug, true AS is_enabled, CAST(r_regionkey * 10 AS INT) AS sort_order FROM region
        UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(100 + n_regionkey AS BIGINT), lower(replace(replace(n_name, '_', '-'), ' ', '-')), n_nationkey % 12 <> 11, CAST(n_nationkey * 10 AS INT) FROM nation""",
    "v_article_categories": """SELECT id AS article_id, id % 25 AS category_id, true AS is_primary FROM raw_articles
        UNION ALL SELECT id, (id * 7 + 1) % 25, false FROM raw_articles WHERE id % 3 = 0 AND id % 25 <> (id * 7 + 1) % 25""",
    "v_countries": "SELECT id AS country_id, iso2, slug, name, is_enabled, sort_order FROM countries",
    "v_article_countries": """SELECT id AS article_id, id * 3 % 26 + 1 AS country_id, 'primary' AS relevance FROM raw_articles
        UNION ALL SELECT id, (id * 3 + 5) % 26 + 1, 'secondary' FROM raw_articles WHERE id % 4 = 0""",
    "v_texts": "SELECT c.id, r.source_id, split_part(c.clean_text, chr(10), 1) AS title, c.clean_text AS description FROM cleaned_articles c JOIN raw_articles r ON c.raw_article_id = r.id",
    "v_health": """SELECT event_id AS observation_id, user_id % 20 AS source_id, ts AS checked_at, event_type <> 'error' AS ok, CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 40 END AS articles_returned FROM events""",
    "v_keywords": "SELECT country_id % 25 AS category_id, alias AS keyword FROM country_aliases",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables in `sf_dir`, without leaving names in the session."""
    text = SQL[name]
    used = {}
    for t in ("raw_articles", "cleaned_articles", "region", "nation", "countries", "events", "country_aliases"):
        for word in ("FROM", "JOIN"):
            if f"{word} {t}" in text:
                used[t] = table(spark, sf_dir, t)
                text = text.replace(f"{word} {t}", f"{word} {{{t}}}")
    return spark.sql(text.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)"), **used)


def inline(sql: str) -> str:
    """A query with the views it names written as common table expressions."""
    names = [n for n in SQL if n in sql]
    if not names:
        return sql
    heads = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {heads}, {body[len('WITH'):]}"
    return f"WITH {heads} {body}"


def registry() -> tuple[dict, dict[str, str], object]:
    """(queries, twins, decorator): the decorator takes the SQL of a query's twin, or nothing, and enters both by the function's name."""
    queries: dict = {}
    twins: dict[str, str] = {}

    def query(sql: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if sql is not None:
                twins[f.__name__] = inline(sql)
            return f

        return register

    return queries, twins, query
