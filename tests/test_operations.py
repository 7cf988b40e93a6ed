import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.operators import classify, feed, ingest, monitor, providers
from newsloom.session import build_session, shared_dir, small
from newsloom.sources import feeds, fetch
from newsloom.streaming import jobs

T0 = datetime(2026, 9, 1, 12)
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the executors can't import a test


def transport(url, headers):
    if url.endswith("/robots.txt"):
        if "closed" in url:
            return 403, {}, None
        if "down" in url:
            raise TimeoutError
        return (404, {}, None) if "free" in url else (200, {}, "User-agent: *\nDisallow: /private/")
    if "broken" in url:
        raise ConnectionError
    if headers.get("If-None-Match") == "v1":
        return 304, {}, None
    return (200, {"ETag": "v1"}, "" if "empty" in url else f"body of {url}") if "missing" not in url else (404, {}, None)


def test_scan_asks_politely(spark):
    urls = ["https://a/x", "https://a/private/x", "https://closed/x", "https://down/x", "https://free/x", "https://a/broken", "https://a/empty", "https://a/missing", " "]
    rows = spark.createDataFrame([(u, "v1" if u == "https://free/x" else None, None) for u in urls], "url string, etag string, last_modified string")
    got = {r["url"]: (r["status"], r["etag"], r["error"]) for r in fetch.scan(rows, transport, delay_s=0.0).collect()}
    assert got == {
        "https://a/x": (200, "v1", None), "https://a/private/x": (None, None, "robots"), "https://closed/x": (None, None, "robots"), "https://down/x": (None, None, "robots"), "https://free/x": (304, "v1", None),
        "https://a/broken": (None, None, "ConnectionError"), "https://a/empty": (200, "v1", "empty"), "https://a/missing": (404, None, "http 404"),
    }
    assert fetch.scan(rows.where("false"), transport).count() == 0


def test_robots_are_read_again_after_a_while():
    asked, now = [], [0.0]
    robots = fetch.Robots(lambda u, h: asked.append(u) or (200, {}, ""), lambda: now[0])
    assert robots.allows("https://a", "https://a/x") and robots.allows("https://a", "https://a/y") and len(asked) == 1
    now[0] = fetch.RULES_S + 1
    assert robots.allows("https://a", "https://a/x") and len(asked) == 2


class Says:
    def __init__(self, answer):
        self.answer = answer

    def complete(self, prompt):
        if isinstance(self.answer, Exception):
            raise self.answer
        return self.answer and f"{self.answer} {prompt}"

    def embed_batch(self, texts):
        if isinstance(self.answer, Exception):
            raise self.answer
        return [[3.0, 4.0] if t != "odd" else None for t in texts]


def test_providers_fall_back_and_never_raise(spark):
    rows = spark.createDataFrame([(1, "p"), (2, None)], "id long, p string")
    got = {r["id"]: (r["response"], r["provider"]) for r in providers.completed(rows, "id", "p", [Says(ValueError()), Says(None), Says("ok")]).collect()}
    assert got == {1: ("ok p", 2), 2: (None, None)}
    assert [r["response"] for r in providers.completed(rows, "id", "p", [Says(None)]).collect()] == [None, None]
    assert isinstance(Says("x"), providers.TextProvider) and isinstance(Says("x"), providers.Embedder)
    waits = []
    calls = iter([providers.Busy(), providers.Busy(9.0), "done"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert providers.attempt(call, sleep=waits.append) == "done" and waits == [1.0, 9.0]


def test_embedding(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["a", " ", None, "odd"] + ["x"] * 70)], "id long, t string")
    got = {r["id"]: r["vector"] for r in providers.embedded(rows, "id", "t", Says("x")).collect()}
    assert [round(v, 6) for v in got[0]] == [0.6, 0.8] and got[1] is None and got[2] is None and got[3] is None and len(got) == 74
    assert all(r["vector"] is None for r in providers.embedded(rows, "id", "t", Says(ValueError())).collect())
    assert providers.embedded(rows, "id", "t", Says(ValueError()), Says("x")).where("vector is not null").count() == 71


def test_summaries(spark):
    rows = spark.createDataFrame([(1, '{"tldr": " t ", "bullets": ["a ", "", null]}'), (2, '{"tldr": "", "bullets": ["a"]}'), (3, "bad"), (4, None), (5, '{"tldr": "t", "bullets": "x"}')], "id long, r string")
    assert {r["id"]: (r["failed"], r["tldr"], r["bullets"]) for r in providers.summaries(rows, "id", "r").collect()} == {1: (False, "t", ["a"]), 2: (True, None, None), 3: (True, None, None), 4: (True, None, None), 5: (True, None, None)}


def test_publishers_are_resolved(spark):
    s = spark.createDataFrame([(5, "The Guardian World", "https://g/rss", "rss"), (6, "Guardian", "https://g2", "discovered"), (7, "Daily Post", "gnews://times", "discovered"), (8, "Wire News", "x", "discovered"), (3, "Guardian Online", "y", "gnews")], "id long, name string, feed_url string, kind string")
    names = spark.createDataFrame([(" Guardian ",), ("Times",), ("Wire",), ("Wire News",), ("",), (None,)], "name string")
    assert {r["name"]: r["source_id"] for r in ingest.resolved_publishers(names, s).collect()} == {"Guardian": 3, "Times": 7, "Wire": None, "Wire News": 8}
    entries = spark.createDataFrame([(1, 100, "Times", "u"), (2, 100, None, "u"), (3, 100, "Nobody", "u"), (4, 100, "Times", " ")], "id long, source_id long, publisher string, url string")
    assert {r["id"]: r["source_id"] for r in ingest.owned(entries, s).collect()} == {1: 7, 2: 100}


def test_deep_trees_and_long_cycles(spark):
    chain = [(k, k - 1 if k else None, f"c{k}", True) for k in range(70)]
    ring = [(100 + k, 100 + (k + 1) % 5, f"r{k}", True) for k in range(5)]
    c = spark.createDataFrame(chain + ring, "category_id long, parent_id long, slug string, is_enabled boolean")
    assert feed.descendants(c, ["c0"]).count() == 70 and feed.descendants(c, ["r0"]).count() == 5
    assert feed.descendants(c.where("false")).count() == 0


def test_next_place(spark):
    rows = spark.createDataFrame([(k, k, "t", T0 - timedelta(hours=k)) for k in range(5)], "id long, source_id long, title string, sort_ts timestamp_ntz")
    assert feed.next_place(feed.page(rows, 5)).first() == (False, None)
    got = feed.next_place(feed.page(rows, 2)).select("has_more", tx.decoded_cursor(F.col("next_cursor")).alias("c")).first()
    assert got["has_more"] and got["c"]["id"] == 1 and got["c"]["stamp"] == T0 - timedelta(hours=1)
    assert feed.next_place(feed.page(rows.where("false"), 2)).first() == (False, None)


def test_patterns_are_trees():
    import random
    import re

    rng = random.Random(2)
    terms = ["".join(rng.choice("ab .'") for _ in range(rng.randint(1, 6))).strip() for _ in range(60)]
    terms = sorted({t for t in terms if re.search("^[ab].*[ab]$|^[ab]$", t)})
    plain = re.compile(r"\b(?:" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + r")\b")
    tree = re.compile(classify.alternation(terms))
    for _ in range(300):
        text = "".join(rng.choice("ab .'") for _ in range(40))
        assert tree.findall(text) == plain.findall(text)


def test_ledger_storage_and_workers(spark):
    events = spark.createDataFrame([(1, "start", T0, None, None, None), (1, "end", T0 + timedelta(minutes=3), 9, 4, None), (2, "start", T0, None, None, None), (3, "end", T0, 1, 1, None)] + [(3, "error", T0 + timedelta(seconds=k), None, None, f"e{k:02}") for k in range(25)], "run_id long, kind string, at timestamp_ntz, entries_seen long, entries_new long, error string")
    got = {r["run_id"]: r for r in monitor.run_ledger(events).collect()}
    assert (got[1]["status"], got[1]["entries_new"], got[2]["status"], got[3]["status"], got[3]["failures"]) == ("success", 4, "running", "partial", 25)
    assert got[3]["errors"] == [f"e{k:02}" for k in range(20)]
    rows = spark.createDataFrame([(None,), (70,), (90,), (100,)], "used long")
    assert [(r["s"]["warn"], r["s"]["stop"]) for r in rows.select(monitor.storage_decision(F.col("used"), 100).alias("s")).collect()] == [(False, False), (True, False), (True, True), (True, True)]
    n = spark.createDataFrame([(0,), (20,), (21,), (80,), (999,)], "n long")
    assert [r[0] for r in n.select(monitor.wanted_workers(F.col("n"))).collect()] == [1, 1, 2, 4, 8]


def test_storage_guard(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"x" * 95)
    assert monitor.stored_bytes(spark, str(tmp_path)) >= 95 and monitor.stored_bytes(spark, str(tmp_path / "none")) == 0
    monitor.guard_storage(spark, str(tmp_path), 10_000)
    with pytest.raises(RuntimeError):
        monitor.guard_storage(spark, str(tmp_path), 100)


def test_shared_folder_is_asked_for(spark, monkeypatch):
    assert shared_dir(spark).startswith("file:")
    with pytest.raises(RuntimeError):
        shared_dir(type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda *a: None)}), "sparkContext": type("X", (), {"master": "yarn"})})())
    assert small(spark.range(10), 10) and not small(spark.range(11), 10) and build_session is not None


def test_published_times(spark):
    rows = spark.createDataFrame([("2026-01-01T10:00:00+02:00",), ("2026-01-01T10:00:00.5Z",), ("2026-01-01 10:00",), ("x",), (None,), ("2026-13-01",)], "s string")
    got = [r[0] for r in rows.select(feeds.published_utc(F.col("s"))).collect()]
    assert got == [datetime(2026, 1, 1, 8), datetime(2026, 1, 1, 10, 0, 0, 500000), datetime(2026, 1, 1, 10), None, None, None]


def test_body_layers():
    long, other = " ".join(["word"] * 60), " ".join(["other"] * 70)
    assert feeds.body_text(f"<p>{other}</p><article><p>{long}</p></article>") == long
    assert feeds.body_text(f"<p>{other}</p><article><p>short</p></article>") == f"{other}\nshort"
    assert feeds.body_text(f"<p>{other}</p>", most_chars=11) == "other other" and feeds.body_text("<p>short</p>") is None and feeds.body_text("") is None
    assert feeds.body_text("<p>short</p>", layers=(lambda p: "mine " * 50,)) == "mine " * 50


def test_work_queue_hands_out_each_row_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, body string")
    rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), "id long, body string", lambda b: b.select("id", F.upper("body").alias("done")), str(tmp_path / "out"), str(tmp_path / "cp"))
    jobs.work_queue(*args).awaitTermination(120)
    spark.createDataFrame([(3, "c")], "id long, body string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = jobs.work_queue(*args)
    q.awaitTermination(120)
    jobs.stop_gracefully(q)
    assert sorted((r["id"], r["done"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "A"), (2, "B"), (3, "C")]
