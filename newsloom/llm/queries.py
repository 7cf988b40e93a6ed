"""Queries of the training-data operators: name -> callable(spark, sf_dir), and their SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.boilerplate import body_blocks
from newsloom.llm.confusables import consistent, lookalike_pairs
from newsloom.llm import languages
from newsloom.llm.mixing import mix, reached_shares
from newsloom.llm.nearduplicates import Duplicates
from newsloom.llm.neighbours import exact_nearest, nearest, similar_pairs
from newsloom.llm.packing import pack, split_items
from newsloom.llm.sentences import sentences
from newsloom.llm.tokens import token_count
from newsloom.llm.truncation import truncated
from newsloom.session import cut, table


def _language_inputs(spark: SparkSession, sf_dir: str):
    """Titles with their source's label, texts with their own, and a model trained on a sample of both."""
    codes = [r["code"] for r in table(spark, sf_dir, "languages").select("code").where("code is not null").distinct().orderBy("code").collect()] or sorted(languages.SEED)  # a table of settings
    sources = table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("site"), languages.normal_label(F.col("language"), codes).alias("label"))
    titles = table(spark, sf_dir, "raw_articles").select(F.col("id").alias("raw_article_id"), "source_id", "title").join(sources, "source_id", "left")
    texts = table(spark, sf_dir, "cleaned_articles").select("id", "raw_article_id", "clean_text", languages.normal_label(F.col("language"), codes).alias("label"))
    model = languages.trained(languages.sample_rows(texts, "id", "clean_text", "label"), languages.sample_rows(titles, "raw_article_id", "title", "label"), codes)
    return titles, texts, model


def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, raw_article_id, text_id, seg_no, lang, confidence, chars, label): every title, and every stretch of every text."""
    titles, texts, model = _language_inputs(spark, sf_dir)
    said = languages.title_languages(titles, "raw_article_id", "title", "site", model, keep=("label",))
    a = said.select(F.lit("title").alias("place"), "raw_article_id", F.lit(None).cast("long").alias("text_id"), F.lit(0).alias("seg_no"), "lang", "confidence", F.lit(None).cast("long").alias("chars"), "label")
    parts = languages.text_stretches(texts, "id", "clean_text", model)
    b = parts.join(texts.select("id", "raw_article_id", "label"), "id")
    return a.unionByName(b.select(F.lit("text").alias("place"), "raw_article_id", F.col("id").alias("text_id"), "seg_no", "lang", "confidence", (F.col("end_char") - F.col("start_char")).alias("chars"), "label"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_article_id, place, seg_no, lang): titles and texts whose label is missing or wrong, and texts of several languages."""
    all_ = p1_languages(spark, sf_dir)
    titles = all_.where("place = 'title' and (label is null or lang <> label)")
    texts = all_.where("place = 'text'")
    per = texts.groupBy("text_id", "raw_article_id", "label", "lang").agg(F.sum("chars").alias("n"), F.collect_list("seg_no").alias("segs"))
    whole = per.groupBy("text_id", "raw_article_id", "label").agg(
        F.max_by("lang", F.struct("n", "lang")).alias("main"), F.count("*").alias("languages"), F.flatten(F.collect_list(F.transform("segs", lambda s: F.struct(s.alias("seg_no"), F.col("lang").alias("lang"))))).alias("parts")
    )
    wrong = whole.where("label is null or main <> label or languages > 1").select("raw_article_id", F.explode("parts").alias("p"))
    out = titles.select("raw_article_id", "place", "seg_no", "lang")
    return out.unionByName(wrong.select("raw_article_id", F.lit("text").alias("place"), F.col("p.seg_no").alias("seg_no"), F.col("p.lang").alias("lang"))).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, id_a, id_b): titles and aliases that look the same but are not the same characters."""
    titles = lookalike_pairs(table(spark, sf_dir, "raw_articles").select("id", "title"), "id", "title")
    aliases = lookalike_pairs(table(spark, sf_dir, "country_aliases").select("id", "alias"), "id", "alias")
    out = titles.select(F.lit("title").alias("field"), "id_a", "id_b")
    return out.unionByName(aliases.select(F.lit("alias").alias("field"), "id_a", "id_b"))


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, id, form): the consistent form of every title and alias."""
    titles = table(spark, sf_dir, "raw_articles").select(F.lit("title").alias("field"), "id", consistent(F.col("title")).alias("form"))
    aliases = table(spark, sf_dir, "country_aliases").select(F.lit("alias").alias("field"), "id", consistent(F.col("alias")).alias("form"))
    return titles.unionByName(aliases)


STORY_SIMILARITY = 0.5


def _stories(spark: SparkSession, sf_dir: str) -> Duplicates:
    raw = table(spark, sf_dir, "raw_articles").select(F.col("id").alias("raw_article_id"), "title", "summary_from_feed")
    texts = table(spark, sf_dir, "cleaned_articles").select("raw_article_id", "clean_text")
    return Duplicates(spark, raw.join(texts, "raw_article_id"), "raw_article_id", ["title", "summary_from_feed", "clean_text"], STORY_SIMILARITY)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b): pairs of raw articles with a cleaned row whose sets of 12-character substrings have a Jaccard similarity of at least 0.5."""
    return _stories(spark, sf_dir).pairs()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_article_id, group_id): the story of every raw article with a cleaned row."""
    return _stories(spark, sf_dir).groups().select(F.col("id").alias("raw_article_id"), "group_id")


def p4_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_article_id, source_id, truncated, log_odds, posterior, ending, mark) of every summary."""
    sources = table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("site"))
    raw = table(spark, sf_dir, "raw_articles").select(F.col("id").alias("raw_article_id"), "source_id", "summary_from_feed")
    located = raw.join(sources, "source_id", "left")
    return truncated(located, "raw_article_id", "source_id", "summary_from_feed", "site", table(spark, sf_dir, "cleaned_articles"), "raw_article_id", "clean_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_article_id, source_id): the articles whose summary was cut."""
    return p4_summaries(spark, sf_dir).where("truncated").select("raw_article_id", "source_id").distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, summaries, cut, share): how often each source cuts its summaries."""
    per = p4_summaries(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("summaries"), F.count_if("truncated").alias("cut"))
    return per.withColumn("share", F.col("cut") / F.col("summaries"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_article_id, field, block_md5): the main-body blocks of every page and of every cleaned text."""
    sources = table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), F.col("name").alias("site"))
    raw = table(spark, sf_dir, "raw_articles").select("id", "source_id", "url", "raw_html")
    host = F.coalesce(F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))
    placed = raw.join(sources, "source_id", "left").select("id", host.alias("host"), "site", "raw_html")
    html = placed.where("raw_html is not null").select("id", F.lit("raw_html").alias("field"), "host", "site", F.col("raw_html").alias("content"))
    cleaned = table(spark, sf_dir, "cleaned_articles").select(F.col("raw_article_id").alias("id"), "clean_text")
    texts = placed.select("id", "host", "site").join(cleaned, "id").select("id", F.lit("clean_text").alias("field"), "host", "site", F.col("clean_text").alias("content"))
    return body_blocks(html.unionByName(texts)).select(F.col("id").alias("raw_article_id"), "field", "block_md5")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens"))


VECTOR_MODEL, VECTOR_DIMS = "local/hash-minilm-384", 384


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "article_embeddings").where(F.col("model_name") == VECTOR_MODEL)
    return rows.select("raw_article_id", "vector_json")


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_article_id, neighbour, rank, similarity): the 10 most similar articles of every article."""
    return nearest(_vectors(spark, sf_dir), "raw_article_id", "vector_json", VECTOR_DIMS)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b): pairs with a cosine of at least 0.8 where one is among the 10 most similar of the other."""
    return similar_pairs(p7_neighbours(spark, sf_dir), "raw_article_id", 0.8)


def p7_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(neighbours, found, recall, close_neighbours, close_found, close_recall) against brute force, for ids divisible by 100; close: cosine at least 0.8."""
    exact = exact_nearest(_vectors(spark, sf_dir), "raw_article_id", "vector_json", VECTOR_DIMS, every=100)
    near = p7_neighbours(spark, sf_dir).select("raw_article_id", "neighbour", F.lit(1).alias("hit"))
    both = exact.join(near, ["raw_article_id", "neighbour"], "left")
    close = F.col("similarity") >= 0.8
    out = both.agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"), F.count_if(close).alias("close_neighbours"), F.count_if(close & F.col("hit").isNotNull()).alias("close_found"))
    return out.withColumns({"recall": F.try_divide(F.col("found"), F.col("neighbours")), "close_recall": F.try_divide(F.col("close_found"), F.col("close_neighbours"))})


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spec_id, doc_id, piece_no, first_token, size, container_id): for every spec, the container of every document or piece."""
    specs = table(spark, sf_dir, "pack_specs").where("capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct().orderBy("spec_id", "capacity_tokens").collect()  # a table of settings
    sized = _sized(spark, sf_dir)
    if len(specs) > 1:
        sized = cut(sized)
    out = None
    for s in specs:
        packed = pack(sized, "doc_id", "tokens", s["capacity_tokens"]).select(F.lit(s["spec_id"]).cast("int").alias("spec_id"), "doc_id", "piece_no", "first_token", "size", "container_id")
        out = packed if out is None else out.unionByName(packed)
    return spark.createDataFrame([], "spec_id int, doc_id long, piece_no long, first_token long, size long, container_id long") if out is None else out


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): documents that alone exceed a capacity, those that the packing splits into several containers."""
    packed = p8_containers(spark, sf_dir).withColumn("item", F.struct("spec_id", "doc_id"))
    return split_items(packed, "item").select("item.doc_id").distinct()


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(containers, tokens, fill): how full the containers of all specs are."""
    used = p8_containers(spark, sf_dir).where("container_id is not null")
    capacity = table(spark, sf_dir, "pack_specs").where("capacity_tokens > 0").groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity"))
    per = used.groupBy("spec_id", "container_id").agg(F.sum("size").alias("size")).join(F.broadcast(capacity), "spec_id")
    total = per.agg(F.count("*").alias("containers"), F.sum("size").alias("tokens"), F.sum("capacity").alias("room"))
    return total.select("containers", "tokens", F.try_divide(F.col("tokens"), F.col("room")).alias("fill"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, place, source, doc_id, repeat_no, tokens): the chosen documents with their repeats, in the order (position, place)."""
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source was to reach and the share that it reached."""
    return reached_shares(p9_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reached shares where as many tokens are asked for as all documents have: small sources stop at their repeats."""
    sized = cut(_sized(spark, sf_dir))
    targets = table(spark, sf_dir, "mix_targets")
    there = sized.join(targets.select("source").distinct(), "source", "left_semi").agg(F.sum("tokens")).first()[0]
    return reached_shares(mix(sized, targets, int(there or 0)), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start_char, end_char): the sentences of every document."""
    return sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_languages": p1_languages,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p4_found": p4_found,
    "p4_summaries": p4_summaries,
    "p4_rates": p4_rates,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_forms": p6_forms,
    "p7_found": p7_found,
    "p7_neighbours": p7_neighbours,
    "p7_recall": p7_recall,
    "p8_found": p8_found,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_shares_capped": p9_shares_capped,
    "p10_found": p10_found,
}
# p7: all pairs by brute force. On tables that fit the curves' windows, as at sf0.01, the operator gives the same rows.
ORACLES: dict[str, str] = {
    "p7_found": """WITH j AS (SELECT raw_article_id AS id, CASE WHEN json_valid(vector_json) THEN CAST(vector_json AS JSON) END AS js FROM article_embeddings WHERE model_name = 'local/hash-minilm-384'),
        e AS (SELECT id, js FROM j WHERE json_type(js) = 'ARRAY' AND json_array_length(js) = 384 AND len(list_filter(json_extract(js, '$[*]'), lambda t: json_type(t) NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT'))) = 0),
        v AS (SELECT DISTINCT id, CAST(js AS DOUBLE[]) AS x FROM e),
        n AS (SELECT id, x FROM v WHERE list_dot_product(x, x) > 0 AND isfinite(list_dot_product(x, x))),
        s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.x, b.x) AS c FROM n a JOIN n b ON a.id <> b.id),
        r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
        SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE k <= 10 AND c >= 0.8"""
}
