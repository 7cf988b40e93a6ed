import base64

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions.urls import canonical_url, url_key
from newsloom.functions.vectors import cosine, vector_literal


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_canonical_url(spark):
    cases = {
        "HTTP://User:pw@Example.COM:80/Story/?utm_source=x&b=2&a=&UTM_Medium=y&ref=1#top": "https://example.com/Story?b=2&a=",
        "https://example.com:443/": "https://example.com/", "http://example.com:8443/a": "https://example.com:8443/a", "example.com/a": "example.com/a", "https://example.com": "https://example.com",
        "https://example.com/a?q=a+b&q=~*": "https://example.com/a?q=a+b&q=~%2A", "  ": "", "https://e.x/a?x": "https://e.x/a?x=",
    }
    got = one(spark, [(u,) for u in cases], "u string", canonical_url(F.col("u")))
    assert dict(zip(cases, got)) == cases
    assert one(spark, [(None,)], "u string", url_key(F.col("u"))) == [None]
    a, b = one(spark, [("http://e.x/a/",), ("https://E.x/a?fbclid=1",)], "u string", url_key(F.col("u")))
    assert a == b and len(a) == 64


def test_markup_and_blocks():
    assert tx.without_markup("<p>A standfirst</p><p></p><p>Body text.</p><p>More</p>") == "A standfirst — Body text. More"
    assert tx.without_markup("a &amp; b<script>x</script>...") == "a & b…"
    assert tx.without_markup(None) is None and tx.without_markup("<p></p>") is None and tx.without_markup("plain  text") == "plain  text"


def test_search_form():
    assert tx.search_form("São Paulo’s ﬁrst-class U.S. test!") == "sao paulo s first-class u.s. test"
    assert tx.search_form(None) is None and tx.search_form("中文") == ""


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .-\t'é", max_size=60))
def test_search_form_is_stable(text):
    once = tx.search_form(text)
    assert tx.search_form(once) == once


def test_truncation(spark):
    got = one(spark, [("alpha beta gamma",), ("alphabetagamma",), ("short",), (None,), ("",)], "t string", tx.truncated(F.col("t"), 10))
    assert got == ["alpha…", "alphabetag…", "short", None, ""]
    assert one(spark, [("alpha beta",)], "t string", tx.truncated(F.col("t"), 0)) == ["alpha beta"]


def test_cleaning(spark):
    raw = "<p>The first long sentence here. The first long sentence here. Short. See https://x.y/z?utm_a=1 now and then please</p>"
    assert one(spark, [(raw,)], "t string", tx.cleaned(F.col("t"))) == ["The first long sentence here. See now and then please"]
    assert one(spark, [("“Quoted” text—that is long enough",), (None,)], "t string", tx.cleaned(F.col("t"))) == ['"Quoted" text - that is long enough', None]


def test_publishers(spark):
    names = ["The Guardian World", "BBC World News", "World News", None, "  ", "Le Monde"]
    rows = [(n,) for n in names]
    assert one(spark, rows, "n string", tx.publisher_identity(F.col("n"))) == ["guardian", "bbc", "world-news", "unknown", "unknown", "le-monde"]
    assert one(spark, rows, "n string", tx.publisher_slug(F.col("n"))) == ["the-guardian-world", "bbc-world-news", "world-news", "unknown", "unknown", "le-monde"]


def test_json_and_fences(spark):
    assert one(spark, [('["a","b"]',), ("[broken",), (None,)], "t string", tx.json_list(F.col("t"))) == [["a", "b"], [], []]
    assert one(spark, [("```json\n{}\n```",), ("``` x```",), ("{}",)], "t string", tx.without_fences(F.col("t"))) == ["{}", "x", "{}"]


def test_cursor_round_trip(spark):
    df = spark.sql("SELECT timestamp_ntz'2026-01-02 03:04:05.6' AS s, 7L AS i UNION ALL SELECT timestamp_ntz'2026-01-02 03:04:05', 8L")
    out = df.select("s", "i", tx.cursor(F.col("s"), F.col("i")).alias("c")).withColumn("x", tx.decoded_cursor(F.col("c"))).collect()
    assert all((r["x"]["stamp"], r["x"]["id"]) == (r["s"], r["i"]) and "=" not in r["c"] for r in out)
    assert base64.urlsafe_b64decode(out[1]["c"] + "==").decode() == "2026-01-02T03:04:05|8"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [0.707107, 0.0]
    assert df.select(vector_literal(F.col("a"))).first()[0] == "[1.000000,0.000000]"
