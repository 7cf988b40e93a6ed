"""Every training-data query over empty tables, and over tables with rows that are null in every column."""

import os

import pytest
from pyspark.sql import functions as F

from newsloom.llm import queries
from newsloom.session import table

SF = "/root/testdata/sf0.001"
TABLES = "raw_articles cleaned_articles article_embeddings documents sources countries country_aliases languages mix_targets pack_specs".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        table(spark, SF, t).where("false").write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.fixture(scope="module")
def nulls(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nulls"))
    for t in TABLES:
        rows = table(spark, SF, t)
        none = rows.limit(2).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in rows.schema])
        kept = rows.limit(1).select(*[F.col(x.name) if x.name in ("id", "doc_id", "raw_article_id", "source_id") else F.lit(None).cast(x.dataType).alias(x.name) for x in rows.schema])
        rows.unionByName(none).unionByName(kept).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty(spark, empty, name):
    n = queries.QUERIES[name](spark, empty).count()
    assert n == (1 if name in ("p7_recall", "p8_fill") else 0)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_nulls(spark, nulls, name):
    """Rows of nulls add nothing to what is found."""
    found = queries.QUERIES[name](spark, nulls)
    if name.endswith("_found") and name != "p1_found":
        assert found.exceptAll(queries.QUERIES[name](spark, SF)).count() == 0
    else:
        assert found.count() >= 0
