from datetime import datetime, timedelta

import pytest

from newsloom.operators import classify, feed, ingest, limits, similarity

T0 = datetime(2026, 9, 1, 12)
ARTICLES = "id long, source_id long, title string, sort_ts timestamp_ntz"


def articles(spark, n=25):
    return spark.createDataFrame([(k, k % 4, f"t{k}", T0 - timedelta(hours=k // 2)) for k in range(n)], ARTICLES)


def test_pages_visit_every_row_once(spark):
    rows, seen, after = articles(spark), [], None
    for _ in range(10):
        part = feed.page(rows if after is None else rows.where(feed.before(rows.sort_ts, rows.id, after)), 6).orderBy("rank").collect()
        seen += [r["id"] for r in part]
        if not part or not part[-1]["has_more"]:
            break
        after = (part[-1]["sort_ts"], part[-1]["id"])
    assert len(seen) == 25 and set(seen) == set(range(25))


def test_interleave_keeps_membership(spark):
    page = feed.page(articles(spark), 10)
    out = [(r["position"], r["id"], r["source_id"]) for r in feed.interleaved(page).orderBy("position").collect()]
    assert sorted(x[1] for x in out) == sorted(r["id"] for r in page.collect())
    assert len({x[2] for x in out[:4]}) == 4


def test_category_tree_and_cycle(spark):
    c = spark.createDataFrame([(1, None, "world", True), (2, 1, "conflict", True), (3, 2, "war", False), (4, 5, "x", True), (5, 4, "y", True)], "category_id long, parent_id long, slug string, is_enabled boolean")
    assert {r[0] for r in feed.descendants(c, ["world"]).select("category_id").collect()} == {1, 2, 3}
    assert {r[0] for r in feed.descendants(c, ["x"]).select("category_id").collect()} == {4, 5}
    direct = spark.createDataFrame([(2, 5), (3, 7)], "category_id long, articles long")
    assert {r["slug"]: r["articles"] for r in feed.rolled_up(direct, c).collect()}["world"] == 5


def test_requests_are_checked():
    assert feed.csv_values(" A, b ,,") == ["a", "b"] and feed.csv_values(None) == []
    with pytest.raises(ValueError):
        feed.csv_values(",".join("x" * 51))
    for bad in ({"limit": 0}, {"limit": 51}, {"days": 91, "now": T0}, {"days": 3}):
        with pytest.raises(ValueError):
            feed.FeedRequest(**bad)


def test_empty_feed(spark):
    assert feed.page(articles(spark, 0), 5).count() == 0
    assert feed.interleaved(feed.page(articles(spark, 0), 5)).count() == 0


def test_first_unseen_latest_changes(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, n int, v string")
    assert {(r["k"], r["v"]) for r in ingest.first_of_each(rows, "k", ["n"]).collect()} == {("a", "y"), ("b", None)}
    assert {(r["k"], r["v"]) for r in ingest.latest(rows, "k", ["n"]).collect()} == {("a", "x"), ("b", None)}
    assert [r["k"] for r in ingest.unseen(rows, rows.where("k = 'a'"), "k").collect()] == ["b"]
    c = ingest.counters(rows, rows.where("k = 'b'"), "k").first()
    assert (c["entries_seen"], c["distinct_new"], c["duplicates"]) == (3, 1, 2)
    stored = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, n int")
    wanted = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4)], "k string, n int")
    assert {r["k"]: r["change"] for r in ingest.change_set(stored, wanted, "k").collect()} == {"a": "unchanged", "b": "updated", "c": "orphan", "d": "created"}
    assert ingest.replaced(stored, wanted.where("k = 'a'"), "k").count() == 3


def test_failure_runs(spark):
    rows = spark.createDataFrame([(1, t, f) for t, f in enumerate([True, True, False, True, True, True])], "source_id long, t int, failed boolean")
    assert [r["consecutive_failures"] for r in ingest.runs(rows, "source_id", ["t"], "failed", rows.t * 0).orderBy("t").collect()] == [1, 2, 0, 1, 2, 3]


def test_failure_runs_over_buckets(spark):
    import random

    rng = random.Random(3)
    flags = [rng.random() < 0.8 for _ in range(300)]
    rows = spark.createDataFrame([(k % 2, k, f) for k, f in enumerate(flags)], "source_id long, t int, failed boolean")
    got = {(r["source_id"], r["t"]): r["consecutive_failures"] for r in ingest.runs(rows, "source_id", ["t"], "failed", (rows.t / 7).cast("int")).collect()}
    for s in (0, 1):
        n = 0
        for t in range(s, 300, 2):
            n = n + 1 if flags[t] else 0
            assert got[(s, t)] == n


def test_robots(spark):
    requests = spark.createDataFrame([("a", "https://a/x"), ("a", "https://a/private/x"), ("b", "https://b/x"), ("c", "https://c/x"), ("d", "https://d/x"), ("e", "https://e/x")], "host string, url string")
    rules = spark.createDataFrame([("a", 200, "User-agent: *\nDisallow: /private/"), ("b", 403, None), ("c", 404, None), ("d", 503, None)], "host string, status int, body string")
    got = {r["url"]: r["allowed"] for r in ingest.allowed_by_robots(requests, rules, "newsloom").collect()}
    assert got == {"https://a/x": True, "https://a/private/x": False, "https://b/x": False, "https://c/x": True, "https://d/x": False, "https://e/x": False}


def test_sliding_window_against_model(spark):
    times = [0, 1, 2, 3, 10, 60, 61, 62, 63, 130]
    rows = spark.createDataFrame([(k, "c", T0 + timedelta(seconds=t)) for k, t in enumerate(times)] + [(99, "d", T0)], "i long, k string, t timestamp_ntz")
    got = {r["i"]: r["accepted"] for r in limits.sliding_window(rows, "k", "t", "i", rate=3, window_s=60).collect()}
    kept = []
    for k, t in enumerate(times):
        kept = [x for x in kept if x > t - 60]
        assert got[k] == (len(kept) < 3)
        if got[k]:
            kept.append(t)
    assert got[99]


def test_token_bucket(spark):
    rows = spark.createDataFrame([(k, "c", T0) for k in range(5)] + [(9, "c", T0 + timedelta(seconds=60))], "i long, k string, t timestamp_ntz")
    got = [r["wait_s"] for r in limits.token_bucket(rows, "k", "t", "i").orderBy("i").collect()]
    assert got == [0.0, 0.0, 0.0, 1.0, 2.0, 0.0]


def test_gazetteer_prefers_long_and_gates(spark):
    aliases = spark.createDataFrame(
        [(1, 1, "New Delhi", 1.0, False, None), (2, 1, "Delhi", 0.5, False, None), (3, 2, "Georgia", 0.9, True, '["Atlanta"]'), (4, 3, "Georgia", 0.8, True, '["Tbilisi"]'), (5, 4, "India", 1.0, False, None), (6, 5, "中国", 1.0, False, None), (7, 6, "x", 1.0, True, "[broken")],
        "id long, country_id long, alias string, weight double, is_ambiguous boolean, requires_context string",
    )
    texts = spark.createDataFrame([(1, "New Delhi votes"), (2, "Georgia race: ATLANTA turnout"), (3, "Indianapolis"), (4, None), (5, ""), (6, "x marks")], "id long, text string")
    got = {(r["id"], r["alias_id"]): r["gated_out"] for r in classify.alias_matches(texts, aliases).collect()}
    assert got == {(1, 1): False, (2, 3): False, (2, 4): True, (6, 7): True}


def test_country_decision(spark):
    ev = spark.createDataFrame([(1, "IN", "alias", 1.2), (1, "US", "alias", 0.5), (2, "GB", "source", 0.65), (3, "FR", "alias", 0.4), (5, "DE", "section", 0.7)], "id long, iso2 string, kind string, weight double")
    ids = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "id long")
    got = {r["id"]: r for r in classify.country_decisions(ids, classify.country_scores(ev)).collect()}
    assert (got[1]["primary"], got[1]["secondary"], got[1]["method"], got[1]["confidence"]) == ("IN", ["US"], "gazetteer", 0.64)
    assert (got[2]["primary"], got[2]["confidence"], got[2]["needs_review"], got[2]["method"]) == ("GB", 0.35, True, "source")
    assert (got[3]["primary"], got[3]["is_international"]) == (None, True) and got[4]["method"] == "none" and got[5]["method"] == "section"
    assert {(r["article_id"], r["label"], r["relevance"]) for r in classify.fan_out(classify.country_decisions(ids, classify.country_scores(ev))).collect()} >= {(1, "IN", "primary"), (1, "US", "secondary")}


def test_categories(spark):
    rules = spark.createDataFrame([("a", "p", 1, ["night trains", "rain"]), ("b", "q", 2, ["clinic"]), ("c", "p", 3, ["train"])], "slug string, parent string, sort_order int, keywords array<string>")
    texts = spark.createDataFrame([(1, "Night trains return", "rain and a clinic"), (2, "Nothing", None), (3, "A clinic", "night trains in the rain")], "id long, title string, description string")
    got = {r["id"]: r for r in classify.category_decisions(texts.select("id"), classify.keyword_scores(texts, rules)).collect()}
    assert (got[1]["primary"], got[1]["confidence"], got[1]["secondary"]) == ("a", 0.5, [])
    assert got[2]["primary"] is None and got[3]["primary"] == "a" and got[3]["secondary"] == ["b"]


def test_window_duplicates(spark):
    v = "id long, vector array<float>"
    window = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], v)
    batch = spark.createDataFrame([(10, [2.0, 0.1]), (11, [1.0, 1.0]), (12, [0.0, 0.0]), (13, None)], v)
    got = {r["id"]: (r["nearest"], r["is_duplicate"]) for r in similarity.window_duplicates(batch, window).collect()}
    assert got[10] == (1, True) and got[11][1] is False and got[12][1] is False and got[13][1] is False
    empty = similarity.window_duplicates(batch, window.where("false")).collect()
    assert len(empty) == 4 and not any(r["is_duplicate"] for r in empty)


def test_section_country(spark):
    df = spark.createDataFrame([("https://e.co/news/india/rss.xml",), ("https://bbc.co.uk/x",), ("https://e.co/indianapolis",), (None,)], "u string")
    assert [r[0] for r in df.select(classify.section_country(df.u)).collect()] == ["IN", "GB", None, None]
