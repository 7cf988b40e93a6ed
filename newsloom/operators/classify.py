"""Rule-based labelling: aliases found in text, evidence scores, decisions. Rules are rows, not code."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import json_list, normalized, word_form, worded

# Weights and thresholds of the country decision.
SOURCE_WEIGHT, SECTION_WEIGHT = 0.65, 0.70
COUNTRY_LEAST, MARGIN_LEAST, CONTENDER_LEAST, CONTENDERS_INTERNATIONAL, SOURCE_ONLY_CAP = 0.60, 0.25, 0.50, 3, 0.35
# Thresholds of the category decision.
CATEGORY_LEAST, SECOND_RATIO, CATEGORY_REVIEW = 1.0, 0.6, 0.4
MOST_TERMS = 200_000  # of a gazetteer or rule set
# URL segments that name a country.
SECTION_COUNTRIES = {
    "india": "IN", "united-states": "US", "usa": "US", "us": "US", "uk": "GB", "britain": "GB", "united-kingdom": "GB",
    "australia": "AU", "canada": "CA", "germany": "DE", "france": "FR", "japan": "JP", "brazil": "BR",
    "south-africa": "ZA", "singapore": "SG", "uae": "AE", "emirates": "AE",
}


def surfaces(aliases: DataFrame) -> DataFrame:
    """Aliases with their searchable surface and context list; aliases that normalise to nothing are dropped."""
    out = aliases.withColumns({"surface": normalized(F.col("alias")), "context": F.transform(json_list(F.col("requires_context")), lambda c: c)})
    return out.where("surface <> ''")


def alternation(terms: list[str]) -> str:
    """One pattern that matches any of the terms as whole words, the longest first: a tree of their common beginnings,
    so a place of the text is tried along one branch, not term by term."""
    ordered = sorted(set(terms))

    def branch(low: int, high: int, depth: int) -> str:
        """Pattern of what the terms from `low` to before `high`, equal up to `depth`, have behind it."""
        ends = len(ordered[low]) == depth  # the shortest comes first
        low += ends
        parts = []
        while low < high:
            stop = low
            while stop < high and ordered[stop][depth] == ordered[low][depth]:
                stop += 1
            common = len(os.path.commonprefix([ordered[low], ordered[stop - 1]]))
            parts.append(re.escape(ordered[low][depth:common]).replace("\\'", "'") + branch(low, stop, common))
            low = stop
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)})" + ("?" if ends else "")

    return rf"\b{branch(0, len(ordered), 0)}\b"


def found_terms(text: Column, terms: list[str]) -> Column:
    """Distinct terms found in normalised text: leftmost, longest first, without overlap."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(alternation(terms)), F.lit(0))) if terms else F.array().cast("array<string>")


def has_word(text: Column, word: Column) -> Column:
    """Whole-word containment by the same rules as the pattern's word boundary, without a pattern for each row."""
    padded = F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9_]", " "), F.lit(" "))
    wanted = F.concat(F.lit(" "), F.regexp_replace(word, "[^a-z0-9_]", " "), F.lit(" "))
    return F.contains(padded, wanted)


def alias_matches(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, alias_id, country_id, alias, weight, gated_out, context_hit) for each alias found in `texts` (id, text).

    The gazetteer is a dimension: its surfaces become one pattern on the driver, at most MOST_TERMS of them (more are
    refused); every match then meets all aliases of its surface by an equi-join, which Spark broadcasts if the aliases'
    size allows. An ambiguous alias counts only where one of its context words occurs.
    """
    known = surfaces(aliases).select(F.col("id").alias("alias_id"), "country_id", "alias", "surface", "weight", "is_ambiguous", "context")
    terms = _terms(known.select("surface"))
    norm = texts.select("id", normalized(F.col("text")).alias("norm")).where("norm <> ''")
    hits = norm.select("id", "norm", F.explode(found_terms(F.col("norm"), terms)).alias("surface"))
    joined = hits.join(known, "surface")
    context = F.filter(F.col("context"), lambda c: has_word(F.col("norm"), F.lower(c)))
    first = F.get(context, F.lit(0))
    return joined.select("id", "alias_id", "country_id", "alias", F.col("weight").alias("weight"), (F.col("is_ambiguous") & first.isNull()).alias("gated_out"), F.when(F.col("is_ambiguous"), first).alias("context_hit"))


def section_country(feed_url: Column, codes: list[str] | None = None) -> Column:
    """The country that a segment of a feed's URL names (host labels count), the first one that does.

    Names count only, unless `codes` are given: then a segment that is one of these two-letter codes names its country too."""
    known = {**{c.lower(): c.upper() for c in codes or []}, **SECTION_COUNTRIES}
    names = F.create_map(*[F.lit(x) for p in known.items() for x in p])
    segments = F.filter(F.split(F.lower(feed_url), r"[/.?=&]+"), lambda s: s != "")
    return F.get(F.filter(F.transform(segments, lambda s: F.try_element_at(names, s)), lambda c: c.isNotNull()), F.lit(0))


def evidence(matches: DataFrame, places: DataFrame, countries: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(id, iso2, kind, weight): all that speaks for a country.

    matches: ungated alias matches (id, country_id, weight); places: (id, source_country, feed_url) of every text;
    countries: (country_id, iso2); gazetteer: (country_id) of all aliases, as a prior counts only for countries that have some."""
    iso = countries.select("country_id", "iso2")
    known = iso.join(gazetteer.select("country_id").distinct(), "country_id", "left_semi").select(F.upper("iso2").alias("iso2")).distinct()
    found = matches.join(iso, "country_id").select("id", "iso2", F.lit("alias").alias("kind"), "weight")
    source = places.select("id", F.upper(F.trim("source_country")).alias("iso2")).join(known, "iso2").select("id", "iso2", F.lit("source").alias("kind"), F.lit(SOURCE_WEIGHT).alias("weight"))
    section = places.select("id", section_country(F.col("feed_url")).alias("iso2")).where("iso2 is not null").select("id", "iso2", F.lit("section").alias("kind"), F.lit(SECTION_WEIGHT).alias("weight"))
    return found.unionByName(source).unionByName(section)


def category_rules(categories: DataFrame, keywords: DataFrame) -> DataFrame:
    """(slug, parent, sort_order, keywords) from stored rows: enabled categories only, the parent by its slug.

    categories: (category_id, parent_id, slug, is_enabled, sort_order); keywords: (category_id, keyword)."""
    words = keywords.where("trim(keyword) <> ''").groupBy("category_id").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))
    parents = categories.select(F.col("category_id").alias("parent_id"), F.col("slug").alias("parent"))
    return categories.where("is_enabled").join(words, "category_id").join(parents, "parent_id", "left").select("slug", "parent", "sort_order", "keywords")


def country_scores(evidence: DataFrame) -> DataFrame:
    """(id, iso2, score, matched, from_source, from_section) from evidence rows (id, iso2, kind, weight)."""
    return evidence.groupBy("id", "iso2").agg(
        F.round(F.sum("weight"), 6).alias("score"), F.count_if(F.col("kind") == "alias").alias("matched"), F.max(F.col("kind") == "source").alias("from_source"), F.max(F.col("kind") == "section").alias("from_section")
    )


def country_decisions(ids: DataFrame, scores: DataFrame) -> DataFrame:
    """One row for each of `ids`: primary country or none, confidence, flags, and the other countries in order."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "iso2", "score", "matched", "from_source", "from_section")))
    per = scores.groupBy("id").agg(ranked.alias("r"))
    top = F.col("top")
    d = ids.join(per, "id", "left").withColumns({"top": F.get("r", F.lit(0)), "second": F.coalesce(F.get("r", F.lit(1))["score"], F.lit(0.0))})
    margin = top["score"] - F.col("second")
    source_only = top["from_source"] & (top["matched"] == 0) & ~top["from_section"]
    raw = F.least(F.lit(1.0), top["score"] / 2 * 0.6 + F.least(margin, F.lit(1.0)) * 0.4)
    conf = F.when(source_only, F.least(raw, F.lit(SOURCE_ONLY_CAP))).otherwise(raw)
    none, low = top.isNull(), top["score"] < COUNTRY_LEAST
    rest = F.slice("r", 2, F.greatest(F.size("r"), F.lit(1)))
    names = lambda keep: F.when(none | low, F.array().cast("array<string>")).otherwise(F.transform(F.filter(rest, keep), lambda x: x["iso2"]))
    method = F.when(none, "none").when(low, "gazetteer").when(top["from_section"] & (top["matched"] == 0), "section").when(top["from_source"] & (top["matched"] == 0), "source").otherwise("gazetteer")
    return d.select(
        "id",
        F.when(~none & ~low, top["iso2"]).alias("primary"),
        F.when(none, 0.0).when(low, F.round(top["score"], 3)).otherwise(F.round(conf, 3)).alias("confidence"),
        (none | low | (F.size(F.filter("r", lambda x: x["score"] >= CONTENDER_LEAST)) >= CONTENDERS_INTERNATIONAL)).alias("is_international"),
        F.when(none, False).when(low, True).otherwise((margin < MARGIN_LEAST) | source_only).alias("needs_review"),
        method.alias("method"),
        names(lambda x: x["score"] >= CONTENDER_LEAST).alias("secondary"),
        names(lambda x: (x["score"] > 0) & (x["score"] < CONTENDER_LEAST)).alias("mentioned"),
    )


def _terms(rows: DataFrame) -> list[str]:
    """The distinct values of a one-column dimension, at most MOST_TERMS."""
    got = [r[0] for r in rows.distinct().limit(MOST_TERMS + 1).collect()]
    if len(got) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return sorted(got)


def _found_words(terms: list[str]):
    """A function from texts to those of `terms`, in word form, that they contain: every word is looked up among
    the terms' first words, so the work follows the text, not the number of terms."""
    begins: dict[str, list[list[str]]] = {}  # terms by their first word
    for t in terms:
        begins.setdefault(t.split()[0], []).append(t.split())

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def find(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            words = (word_form(text) or "").split() if isinstance(text, str) else []
            found = {" ".join(t) for k, w in enumerate(words) if w in begins for t in begins[w] if words[k : k + len(t)] == t}
            return sorted(f" {t} " for t in found)

        return texts.map(one)

    return find


def keyword_scores(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, slug, parent, score) for `texts` (id, title, description): 1 for a keyword in the title, else 0.5 in the description."""
    words = rules.select("slug", "parent", "sort_order", F.explode("keywords").alias("k")).select("slug", "parent", "sort_order", worded(F.col("k")).alias("keyword")).where("trim(keyword) <> ''")
    find = _found_words(_terms(words.select("keyword")))
    hits = texts.select("id", find(F.col("title")).alias("in_t"), find(F.col("description")).alias("in_d"))
    hits = hits.select("id", F.explode(F.concat(F.transform("in_t", lambda k: F.struct(k.alias("keyword"), F.lit(1.0).alias("w"))), F.transform(F.array_except("in_d", "in_t"), lambda k: F.struct(k.alias("keyword"), F.lit(0.5).alias("w"))))).alias("h"))
    return hits.select("id", F.col("h.keyword").alias("keyword"), F.col("h.w").alias("w")).join(words, "keyword").groupBy("id", "slug", "parent", "sort_order").agg(F.sum("w").alias("score"))


def category_decisions(ids: DataFrame, scores: DataFrame) -> DataFrame:
    """One row for each of `ids`: primary category or none, confidence, review flag, at most two of other parents."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "sort_order", "slug", "parent", "score")))
    d = ids.join(scores.groupBy("id").agg(ranked.alias("r")), "id", "left").withColumn("top", F.get("r", F.lit(0)))
    top = F.col("top")
    none, low = top.isNull(), top["score"] < CATEGORY_LEAST
    conf = F.least(F.lit(1.0), top["score"] / 3)
    rest = F.slice("r", 2, F.greatest(F.size("r"), F.lit(1)))
    second = F.slice(F.filter(rest, lambda x: (x["score"] >= top["score"] * SECOND_RATIO) & ~x["parent"].eqNullSafe(top["parent"])), 1, 2)
    return d.select(
        "id",
        F.when(~none & ~low, top["slug"]).alias("primary"),
        F.when(none, 0.0).when(low, F.round(top["score"], 2)).otherwise(F.round(conf, 2)).alias("confidence"),
        F.when(none | low, F.array().cast("array<string>")).otherwise(F.transform(second, lambda x: x["slug"])).alias("secondary"),
        F.when(none | low, True).otherwise(conf < CATEGORY_REVIEW).alias("needs_review"),
    )


def fan_out(decisions: DataFrame) -> DataFrame:
    """(article_id, label, relevance, confidence): bridge rows of country or category decisions; only the primary one has a confidence."""
    if "mentioned" not in decisions.columns:
        decisions = decisions.withColumn("mentioned", F.array().cast("array<string>"))
    tagged = F.concat(
        F.when(F.col("primary").isNotNull(), F.array(F.struct(F.col("primary").alias("label"), F.lit("primary").alias("relevance"), F.col("confidence").alias("confidence")))).otherwise(F.array().cast("array<struct<label:string,relevance:string,confidence:double>>")),
        F.transform("secondary", lambda c: F.struct(c.alias("label"), F.lit("secondary").alias("relevance"), F.lit(0.0).alias("confidence"))),
        F.transform("mentioned", lambda c: F.struct(c.alias("label"), F.lit("mentioned").alias("relevance"), F.lit(0.0).alias("confidence"))),
    )
    return decisions.select(F.col("id").alias("article_id"), F.explode(tagged).alias("x")).select("article_id", "x.label", "x.relevance", "x.confidence")


def bridge_rows(fanned: DataFrame, labels: DataFrame, articles: DataFrame) -> DataFrame:
    """(article_id, label_id, is_primary, confidence, published_at): fanned-out labels by their ids (labels: label,
    label_id), with the article's time beside them (articles: article_id, published_at); unknown labels are dropped."""
    out = fanned.join(labels, "label").join(articles, "article_id")
    return out.select("article_id", "label_id", (F.col("relevance") == "primary").alias("is_primary"), "confidence", "published_at")


def evaluated(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """(tag, cases, passed, false_positives, misses) of labelled cases (id, expect, allow, must_not, tags) against
    predictions (id, primary). A false positive is a label where none was expected or one that must not be; a miss is
    none where one was."""
    j = cases.join(predictions.select("id", "primary"), "id", "left")
    ok = F.when(F.size("allow") > 0, F.coalesce(F.array_contains("allow", F.col("primary")), F.lit(False))).otherwise(F.col("expect").eqNullSafe(F.col("primary")))
    vetoed = F.coalesce(F.array_contains("must_not", F.col("primary")), F.lit(False))
    wrong = F.col("primary").isNotNull() & (vetoed | (F.col("expect").isNull() & (F.size("allow") == 0)))
    missed = F.col("primary").isNull() & F.col("expect").isNotNull() & (F.size("allow") == 0)
    each = j.select(F.explode("tags").alias("tag"), (ok & ~vetoed).alias("ok"), wrong.alias("wrong"), missed.alias("missed"))
    return each.groupBy("tag").agg(F.count("*").alias("cases"), F.count_if("ok").alias("passed"), F.count_if("wrong").alias("false_positives"), F.count_if("missed").alias("misses"))
