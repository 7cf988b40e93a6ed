import json
import random

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import nearduplicates as nd
from newsloom.llm import neighbours as nb
from newsloom.session import cut


def brute(rows, threshold):
    sets = {}
    for k, *fields in rows:
        t = nd.joined_text(*fields)
        sets.setdefault(k, {t[i : i + nd.WIDTH] for i in range(len(t) - nd.WIDTH + 1)})
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def story(rng, n=120):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 99))
    return " ".join(words)


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    base = [story(rng) for _ in range(12)]
    rows = [(k, base[k % 12][:30], None if k % 5 else "s", edited(rng, base[k % 12], k // 12)) for k in range(60)]
    rows += [(100, "copy", "", base[0]), (101, "COPY ", None, base[0] + "  "), (102, None, None, None), (103, "short", None, None), (100, "copy", "", base[0])]
    df = spark.createDataFrame(rows, "id long, title string, summary string, body string")
    found = nd.Duplicates(spark, df, "id", ["title", "summary", "body"], 0.5)
    assert {(r["id_a"], r["id_b"]) for r in found.pairs().collect()} == brute(rows, 0.5)
    groups = {r["id"]: r["group_id"] for r in found.groups().collect()}
    assert set(groups) == {r[0] for r in rows} and groups[102] == 102 and groups[12] == groups[0] and groups[101] == groups[100]


def test_a_crowd_of_near_copies_stays_linked(spark):
    rng = random.Random(5)
    base = story(rng)
    rows = [(k, edited(rng, base, 2)) for k in range(150)] + [(500 + k, story(rng)) for k in range(30)]
    found = nd.Duplicates(spark, spark.createDataFrame(rows, "id long, body string"), "id", ["body"], 0.5)
    assert {(r["id_a"], r["id_b"]) for r in found.pairs().collect()} == brute(rows, 0.5)
    assert found.groups().where("id < 150").select("group_id").distinct().count() == 1


def test_no_records(spark):
    found = nd.Duplicates(spark, spark.createDataFrame([], "id long, body string"), "id", ["body"], 0.5)
    assert found.pairs().count() == 0 and found.groups().count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (9, 8), (20, 21), (7, 8)], "a long, b long")
    assert {r["id"]: r["head"] for r in nd.components(links).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 8: 1, 7: 1, 20: 20, 21: 20}


def test_pivot_distances_bound_the_hamming_distance():
    rng = np.random.default_rng(0)
    minima = rng.integers(0, 2**57, (40, nd.BITS), dtype=np.uint64)
    minima[1, : nd.BLOCK] = minima[0, : nd.BLOCK]
    keys, _ = nd.pivot_coordinates(minima)
    blocks = np.ascontiguousarray((nd._mix(minima[:, : nd.TABLES * nd.BLOCK]) & np.uint64(0xFFFF)).astype(np.uint16)).view(np.uint64)
    coords = np.stack([keys >> 7 * r & 127 for r in range(nd.REFERENCES)], 2)
    for i in range(40):
        for j in range(i):
            assert (np.abs(coords[i] - coords[j]).max(1) <= np.bitwise_count(blocks[i] ^ blocks[j])).all()
    assert keys[0, 0] == keys[1, 0] and (keys[0, 1:] != keys[1, 1:]).all() and (keys >> 56 == np.arange(nd.TABLES)).all()


def test_without_pivot_tables_nothing_is_found(spark, monkeypatch):
    rng = random.Random(8)
    base = story(rng)
    df = spark.createDataFrame([(k, edited(rng, base, 2)) for k in range(6)], "id long, body string")
    assert nd.Duplicates(spark, df, "id", ["body"], 0.5).pairs().count() == 15
    monkeypatch.setattr(nd, "pivot_coordinates", lambda m: (np.random.default_rng().integers(0, 2**56, (len(m), nd.TABLES)), np.zeros((len(m), nd.TABLES * nd.BLOCK), np.uint8)))
    assert nd.Duplicates(spark, df, "id", ["body"], 0.5).pairs().count() == 0


def test_leaves_and_leaders_of_a_sorted_table():
    keys, steps = np.array([1, 1, 2] + [5] * 40 + [9] * 20), np.zeros(63, np.int64)
    steps[43:] = np.arange(20) // 10 << 56
    first, second, leader = nd.neighbours_in_order(keys, steps, 16)
    pairs = set(zip(first.tolist(), second.tolist()))
    assert (0, 1) in pairs and not any(a == 2 or b == 2 for a, b in pairs)
    assert {(3, k) for k in range(4, 43)} <= pairs and (leader[3:43] == 3).all() and (leader[43:] == -1).all()
    assert {(43 + i, 43 + j) for h in (0, 10) for i in range(h, h + 10) for j in range(i + 1, h + 10)} <= pairs
    assert len(first) <= 63 * (16 + nd.STEPS)
    assert all(len(x) == 0 for x in nd.neighbours_in_order(np.zeros(0, np.int64), np.zeros(0, np.int64)))


def test_work_grows_with_a_group_of_thousands(spark):
    """A group of 5000 records: candidates in proportion to its records, one group, whatever bounds cut its nodes."""
    rng = random.Random(6)
    base = story(rng, 60)
    df = spark.createDataFrame([(k, f"{base} {k} {rng.randint(0, 10**9)}") for k in range(5000)], "id long, body string")
    records = nd.Records(spark, df, "id", ["body"])
    seen = nd._candidates(records.heads, nd.radius(0.5)).count()
    assert seen <= 5000 * nd.TABLES * (nd.LEAF / 2 + nd.STEPS)
    found = nd.Duplicates(spark, df, "id", ["body"], 0.5)
    assert found.groups().select("group_id").distinct().count() == 1 and found.groups().count() == 5000


def test_stories_in_a_crowd_that_shares_a_template(spark):
    """Dissimilar stories in one template: the true pairs among them are found, in few and in many partitions."""
    rng = random.Random(7)
    template = story(rng, 60)
    rows = [(k, f"{template} {story(rng, 90)}") for k in range(600)]
    rows += [(1000 + k, edited(rng, rows[k][1], 3)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, body string")
    want = brute(rows, 0.5)
    assert len(want) >= 60
    for size in (nd.ROWS, 500):
        whole, nd.ROWS = nd.ROWS, size
        try:
            got = {(r["id_a"], r["id_b"]) for r in nd.Duplicates(spark, df, "id", ["body"], 0.5).pairs().collect()}
        finally:
            nd.ROWS = whole
        assert got <= want and len(got) >= 0.99 * len(want)


def test_lone_pairs_near_the_threshold(spark):
    """Pairs that share little more than half their windows, long and short, each without a third record."""
    rng = random.Random(11)
    rows = []
    for k in range(180):
        words, n = story(rng, 120).split(), rng.randint(34, 38)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 120 - n] + story(rng, n).split()))]
    for k in range(180, 220):
        words = story(rng, 8).split()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:6] + story(rng, 2).split()))]
    df = spark.createDataFrame(rows, "id long, body string")
    assert {(r["id_a"], r["id_b"]) for r in nd.Duplicates(spark, df, "id", ["body"], 0.5).pairs().collect()} == brute(rows, 0.5)


def test_pairs_near_the_threshold_in_a_crowd(spark, monkeypatch):
    """A crowd in one template, some pairs of it a little above the threshold: all are found and grouped, in whole and in divided nodes."""
    rng = random.Random(12)
    template = story(rng, 60)
    rows = [(k, f"{template} {story(rng, 80)}") for k in range(400)]
    for k in range(130):
        words, n = rows[k][1].split(), rng.randint(38, 44)
        rows.append((1000 + k, " ".join(words[: 140 - n] + story(rng, n).split())))
    df, want = spark.createDataFrame(rows, "id long, body string"), brute(rows, 0.5)
    assert len(want) >= 120
    for cell in (nd.CELL, 30):
        monkeypatch.setattr(nd, "CELL", cell)
        found = nd.Duplicates(spark, df, "id", ["body"], 0.5)
        assert {(r["id_a"], r["id_b"]) for r in found.pairs().collect()} == want
    head = {r["id"]: r["group_id"] for r in found.groups().collect()}
    assert all(head[a] == head[b] for a, b in want)


def test_meetings_are_all_pairs_of_a_node_across_groups(monkeypatch):
    rng = np.random.default_rng(3)
    node, group = rng.integers(0, 12, 150).astype(np.uint64), np.sort(rng.integers(0, 40, 150))
    want = {(i, j) for i in range(150) for j in range(i) if node[i] == node[j] and group[i] != group[j]}
    for most in (nd.MEET, 7):
        monkeypatch.setattr(nd, "MEET", most)
        got = [(max(p), min(p)) for i, j in nd._meetings(node, group) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(want) and set(got) == want
    assert not list(nd._meetings(np.arange(5, dtype=np.uint64), np.arange(5))) and not list(nd._meetings(np.zeros(5, np.uint64), np.zeros(5)))


def test_further_minima_are_six_bits_of_which_the_fingerprint_has_two():
    minima = np.random.default_rng(4).integers(0, 2**57, (30, nd.BITS), dtype=np.uint64)
    minima[1] = minima[0]
    values = nd.beside_values(nd.fingerprints(minima).view(np.int64), np.stack([np.frombuffer(x.tobytes(), np.uint8) for x in nd.beside_bits(minima)]))
    assert (values == nd._mix(minima[:, nd._COLUMNS[nd.LONE : nd.LONE + nd.BESIDE]]) & np.uint64(63)).all()
    assert nd.beside_bits(minima).shape[1] == nd.BESIDE // 2 and len(set(nd._COLUMNS.tolist())) == nd.LONE + nd.BESIDE


def test_shuffle_files_go_with_their_step_and_heads_are_not_shuffled_again(spark):
    import time

    rng = random.Random(13)
    rows = [(k, story(rng)) for k in range(120)]
    rows += [(1000 + k, rows[k][1]) for k in range(20)] + [(2000 + k, edited(rng, rows[k][1], 3)) for k in range(20)]
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in (str(x) for x in files.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}

    before = shuffled()
    found = nd.Duplicates(spark, spark.createDataFrame(rows, "id long, body string"), "id", ["body"], 0.5)
    for _ in range(20):  # they are removed in the background
        left = shuffled() - before
        if not left:
            break
        time.sleep(0.5)
    assert not left
    assert "Exchange" not in found.records.heads._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert {(r["id_a"], r["id_b"]) for r in found.pairs().collect()} == brute(rows, 0.5)


def test_parsing():
    ok = [1.0] + [0.0] * 3
    assert nb.parse_vector(json.dumps(ok), 4) is not None
    for bad in (None, "", "[1,2", "[1,2,3]", '["1",2,3,4]', "[null,1,2,3]", "[true,1,2,3]", "[NaN,1,2,3]", "[Infinity,1,2,3]", "[0,0,0,0]", "{}", "5", "[1e999,1,1,1]"):
        assert nb.parse_vector(bad, 4) is None
    assert nb.parse_vector("[1e-3, 2E-3, -0, 3]", 4) is not None


def test_hilbert_visits_neighbours():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(nb.hilbert(cells, 3))]
    assert len(set(nb.hilbert(cells, 3).tolist())) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(300, 32))
    x = np.repeat(centres, 6, axis=0) + rng.normal(size=(1800, 32)) * 0.15
    rows = [(k, json.dumps(v.round(5).tolist())) for k, v in enumerate(x)] + [(9000, None), (9001, "[1]"), (5, json.dumps(x[5].round(5).tolist()))]
    df = spark.createDataFrame(rows, "id long, v string")
    near = cut(nb.nearest(df, "id", "v", 32, k=5, half=128))
    exact = nb.exact_nearest(df, "id", "v", 32, every=10, k=5)
    hit = exact.join(near.select("id", "neighbour"), ["id", "neighbour"], "left_semi").count()
    assert hit / exact.count() >= 0.9
    assert near.where("id = neighbour").count() == 0 and near.groupBy("id").count().where("count <> 5").count() == 0
    pairs = nb.similar_pairs(near, "id", 0.8)
    assert pairs.where("id_a >= id_b").count() == 0 and pairs.count() == pairs.distinct().count()


def test_recall_holds_where_the_window_is_a_small_share(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 12))
    df = spark.createDataFrame([(k, json.dumps(v.round(5).tolist())) for k, v in enumerate(x)], "id long, v string")
    near = cut(nb.nearest(df, "id", "v", 12, k=5, half=24))
    exact = nb.exact_nearest(df, "id", "v", 12, every=5, k=5)
    assert exact.join(near.select("id", "neighbour"), ["id", "neighbour"], "left_semi").count() / exact.count() >= 0.9
    assert near.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("neighbour").alias("d")).where("n <> 5 or d <> 5").count() == 0
    assert nb.curves_for(20 * nb.HALF) == nb.CURVES < nb.curves_for(200 * nb.HALF) < nb.curves_for(2000 * nb.HALF)


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, "[1,0]"), (2, "[1,0.1]"), (3, "bad")], "id long, v string")
    assert {(r["id"], r["neighbour"]) for r in nb.nearest(df, "id", "v", 2).collect()} == {(1, 2), (2, 1)}
    assert nb.nearest(df.where("false"), "id", "v", 2).count() == 0
    same = spark.createDataFrame([(k, "[1,2]") for k in range(50)], "id long, v string")
    assert nb.nearest(same, "id", "v", 2, k=3).groupBy("id").agg(F.count("*").alias("n")).where("n = 3").count() == 50


def test_found_pairs_match_sql(spark):
    import os

    import duckdb
    import pytest

    from newsloom.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW article_embeddings AS SELECT * FROM '{sf}/article_embeddings.parquet'")
    want = set(con.execute(queries.ORACLES["p7_found"]).fetchall())
    assert {(r["id_a"], r["id_b"]) for r in queries.p7_found(spark, sf).collect()} == want and want


def test_every_query_runs(spark):
    import os

    import pytest

    from newsloom.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    for name, query in queries.QUERIES.items():
        assert query(spark, sf).count() > 0 or name == "p6_found", name
