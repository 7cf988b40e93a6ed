from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.llm import confusables as cf
from newsloom.llm import mixing, packing, ranks
from newsloom.llm.tokens import token_count


@pytest.mark.parametrize(
    "a, b",
    [
        ("ＦＵＬＬ　ｗｉｄｔｈ", "FULL width"), ("café", "café"), ("so­ft hy​phen", "soft hyphen"), ("a b c", "a b c"), ("ﬁne", "fine"), ("рареr", "paper"), ("Ηοuse", "House"), ("ｶﾞｱ", "ガア"),
        ("оса видна", "ocа виднa"), ("арóѕ а tempestade", "após a tempestade"), ("ﻻ", "لا"), ("ی", "ي"),
    ],
)
def test_looking_the_same(a, b):
    assert cf.consistent_form(a) == cf.consistent_form(b)


@pytest.mark.parametrize("a, b", [("Paper", "paper"), ("cote", "côte"), ("a-b", "a–b"), ("one two", "onetwo"), ("жук", "xyk")])
def test_not_looking_the_same(a, b):
    assert cf.consistent_form(a) != cf.consistent_form(b)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aоοрcАBЖgжéｅ ﬁ​́", max_size=12))
def test_form_is_stable(text):
    once = cf.consistent_form(text)
    assert cf.consistent_form(once) == once


def test_pairs(spark):
    rows = [(1, "paper", 0), (2, "рареr", 0), (3, "paper", 0), (4, "Paper", 0), (5, None, 0), (6, "", 0), (2, "рареr", 0), (7, "​", 0)]
    got = cf.lookalike_pairs(spark.createDataFrame(rows, "id long, t string, form int"), "id", "t").collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == {(1, 2), (2, 3)} and len(got) == 2
    assert cf.lookalike_pairs(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


def test_recipes_use_every_item_and_fit():
    counts = {70: 3, 40: 5, 33: 10, 10: 100, 1: 7}
    left = Counter()
    for times, one in packing.recipes(counts, 100):
        assert sum(b * n for b, n in one.items()) <= 100
        for b, n in one.items():
            left[b] += n * times
    assert left == counts


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 5000))
def test_bounds_hold_every_size(capacity):
    bounds = packing.class_bounds(capacity)
    assert bounds[0] >= 1 and bounds[-1] == capacity and list(bounds) == sorted(set(bounds))


def test_packing(spark):
    sizes = [(k, (k * 37) % 900 + 1) for k in range(3000)] + [(5000, 2500), (5001, 0), (5002, None), (5003, 1000), (7, 50), (7, 50)]
    out = packing.pack(spark.createDataFrame(sizes, "id long, size long"), "id", "size", 1000)
    rows = out.collect()
    load, pieces = Counter(), Counter()
    for r in rows:
        if r["container_id"] is not None:
            load[r["container_id"]] += r["size"]
            pieces[r["id"]] += r["size"]
    assert max(load.values()) <= 1000 and pieces[5000] == 2500 and pieces[5003] == 1000
    assert sum(load.values()) == sum(s or 0 for _, s in sizes) and sum(load.values()) / (len(load) * 1000) > 0.93
    assert {r["id"] for r in packing.split_items(out, "id").collect()} == {5000}
    assert {r["id"] for r in rows if r["container_id"] is None} == {5001, 5002}
    assert packing.pack(spark.createDataFrame([], "id long, size long"), "id", "size", 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(out, "id", "size", 0)


def test_running_totals(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id"), F.xxhash64("id").alias("h")).withColumn("b", ranks.hash_bucket(F.col("h"), 16))
    got = ranks.running(df, ["k"], "b", ["h"], "r").orderBy("k", "b", "h").collect()
    assert [r["r"] for r in got] == [*range(500), *range(500)]


def test_sieve_loses_nothing(spark):
    wanted = spark.range(0, 1000, 7)
    keep = ranks.sieve(wanted, "id")
    kept = {r[0] for r in keep(spark.range(1000), "id").collect()}
    assert kept >= {r[0] for r in wanted.collect()} and len(kept) < 300


def test_mixture(spark):
    docs = [(k, "a", 100) for k in range(300)] + [(1000 + k, "b", 50) for k in range(40)] + [(2000, "b", None), (2001, None, 10), (2002, "d", 10), (2003, "a", 0)]
    targets = [("a", 3.0, 1), ("b", 1.0, 2), ("c", 5.0, 3), ("x", None, 1), (None, 1.0, 1), ("z", 0.0, 1)]
    d, t = spark.createDataFrame(docs, "doc_id long, source string, tokens long"), spark.createDataFrame(targets, "source string, target_weight double, max_repeats int")
    out = mixing.mix(d, t, block_tokens=500)
    rows = out.collect()
    tokens = Counter()
    uses = Counter((r["source"], r["doc_id"]) for r in rows)
    for r in rows:
        tokens[r["source"]] += r["tokens"]
    assert set(tokens) == {"a", "b"} and tokens["b"] == 4000 and abs(tokens["a"] - 12000) <= 100
    assert all(n <= (2 if s == "b" else 1) for (s, _), n in uses.items())
    shares = {r["source"]: r for r in mixing.reached_shares(out, t).collect()}
    assert abs(shares["a"]["reached_share"] - 0.75) < 0.01 and shares["c"]["tokens"] == 0
    # every prefix is close to the targets
    seen = Counter()
    for r in sorted(rows, key=lambda r: r["position"]):
        seen[r["source"]] += r["tokens"]
        if sum(seen.values()) > 6000:
            assert 0.55 < seen["a"] / sum(seen.values()) < 0.95
    assert mixing.mix(d.where("false"), t).count() == 0 and mixing.mix(d, t.where("false")).count() == 0
    big = mixing.mix(d, t, total_tokens=10**9)
    assert big.where("source = 'b'").agg(F.sum("tokens")).first()[0] == 4000


def test_token_counts(spark):
    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("word " * 20_000,)], "t string")
    got = [r[0] for r in df.select(token_count(F.col("t"))).collect()]
    assert got[0] == 2 and got[1] == 0 and got[2] is None and got[3] >= 20_000
