from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.sources import feeds
from newsloom.streaming import jobs

RSS = """<?xml version="1.0"?><rss><channel><item><title>One</title><link>http://e.x/1/?utm_source=a</link><description>&lt;p&gt;d&lt;/p&gt;</description><pubDate>Mon, 01 Sep 2025 10:00:00 GMT</pubDate></item>
<item><title></title><link>http://e.x/2</link></item><item><title>Copy</title><link>https://e.x/1</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Two</title><link href="https://e.x/2"/><summary>s</summary><updated>2025-09-01T00:00:00Z</updated></entry></feed>"""


def test_feed_documents(spark):
    docs = spark.createDataFrame([("a", RSS), ("b", ATOM), ("c", "<broken"), ("d", None), ("e", "")], "n string, t string")
    got = [(r["feed"], r["title"], r["url"], r["summary"]) for r in feeds.parse_feeds(docs, "n", "t").orderBy("feed", "entry_no").collect()]
    assert got == [("a", "One", "http://e.x/1/?utm_source=a", "<p>d</p>"), ("a", "Copy", "https://e.x/1", None), ("b", "Two", "https://e.x/2", "s")]


def test_aggregator(spark):
    docs = spark.createDataFrame([('{"articles":[{"title":" T ","url":"u","publishedAt":"x","source":{"name":"P"}},{"title":"T","url":"u"}]}',), ("[bad",), (None,)], "t string")
    assert [(r["title"], r["publisher"]) for r in feeds.flatten_aggregator(docs, "t").collect()] == [("T", "P")]


def test_bodies(spark):
    long = " ".join(["word"] * 60)
    pages = spark.createDataFrame([(1, f"<nav><p>menu</p></nav><p>{long}</p><script>x</script>"), (2, "<p>short</p>"), (3, None), (4, "<p>a<p>" * 3)], "id long, html string")
    got = {r["id"]: r["body"] for r in feeds.page_bodies(pages, "id", "html").collect()}
    assert got == {1: long, 2: None, 3: None, 4: None}


def test_seed_file(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("languages:\n  - {code: en, name: English}\n  - {code: fr}\n")
    assert [(r["code"], r["name"]) for r in feeds.read_seed(spark, str(tmp_path / "s.yaml"), "languages", "code string, name string").collect()] == [("en", "English"), ("fr", None)]


def test_ingest_stream_adds_each_key_once(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.xml").write_text(RSS)
    args = (spark, str(landing), str(tmp_path / "out"), str(tmp_path / "cp"))
    jobs.ingest_stream(*args).awaitTermination(120)
    (landing / "b.xml").write_text(ATOM)
    (landing / "c.xml").write_text(RSS)
    jobs.ingest_stream(*args).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["canonical_url"] for r in rows) == ["https://e.x/1", "https://e.x/2"]
    assert {r["title"] for r in rows} == {"One", "Two"}


def test_breaker_and_admission_streams(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    rows = spark.createDataFrame([(1, k, t0 + timedelta(seconds=k), f) for k, f in enumerate([True, True, True, False, True])], "source_id long, observation_id long, checked_at timestamp, failed boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "obs"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "obs"))
    q = jobs.breaker_stream(stream).writeStream.format("memory").queryName("breaker").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert [r["consecutive_failures"] for r in spark.table("breaker").orderBy("observation_id").collect()] == [1, 2, 3, 0, 1]
    events = rows.select(F.lit("c").alias("client"), F.col("observation_id").alias("event_id"), F.col("checked_at").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = jobs.admission_stream(stream, rate=2, window_s=3).writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert [r["accepted"] for r in spark.table("admitted").orderBy("event_id").collect()] == [True, True, False, True, True]
