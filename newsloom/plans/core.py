"""Queries of the core package: name -> callable(spark, sf_dir), and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.timestamps import normalise_instants
from newsloom.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_article_id, published_us): one UTC instant for every raw article whose published_at states a moment."""
    sources = table(spark, sf_dir, "sources").select(F.col("id").alias("source_id"), "tz", "date_order")
    raw = table(spark, sf_dir, "raw_articles").select(F.col("id").alias("raw_article_id"), "source_id", "published_at")
    located = raw.join(sources, "source_id", "left")
    out = normalise_instants(located, "published_at", "tz", "date_order")
    return out.where("published_us is not null").select("raw_article_id", "published_us").distinct()


QUERIES = {"p3_found": p3_found}
ORACLES: dict[str, str] = {}
