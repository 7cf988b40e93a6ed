import hashlib

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import boilerplate as bp
from newsloom.llm import truncation as tr


def sentences(k):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "epsilon"]
    return " ".join(f"The {words[(k * 7 + j * 3) % 10]}{k}x{j} report number {j} says {words[(k + j) % 10]} will come{'.' if j % 2 else ' and stay there.'}" for j in range(3 + k % 4))


def test_truncation(spark):
    rows = []
    for k in range(200):  # source 1 cuts at 60 characters, source 2 never
        rows.append((k, 1, sentences(k)[:60].rstrip(), "Site One"))
        rows.append((1000 + k, 2, sentences(k), "Site Two"))
    rows += [
        (5000, 2, "It is a complete sentence. (Site Two)", "Site Two"), (5001, 2, "It is complete and only the stop is miss<br", "Site Two"), (5002, 2, "", "Site Two"), (5003, 2, None, "Site Two"),
        (5004, 2, sentences(3)[:-1], "Site Two"), (5005, 2, "The firm paid about 14.", None), (5006, None, "No source here at all.", None), (5007, 2, "<p>" + sentences(5) + "</p>", "Site Two"), (5008, 2, sentences(6)[:45] + "…", "Site Two"),
    ]
    df = spark.createDataFrame(rows, "id long, source_id long, s string, site string")
    full = spark.createDataFrame([(5004, sentences(3) + " More."), (5008, sentences(6)), (5004, sentences(3) + " More."), (77777, None)], "rid long, t string")
    got = {r["id"]: r["truncated"] for r in tr.truncated(df, "id", "source_id", "s", "site", full, "rid", "t").collect()}
    assert np.mean([got[k] for k in range(200)]) > 0.9 and np.mean([got[1000 + k] for k in range(200)]) < 0.02
    assert [got[k] for k in (5000, 5001, 5004, 5006, 5007, 5008)] == [False, True, False, False, False, True]
    assert 5002 not in got and 5003 not in got
    assert tr.truncated(df.where("false"), "id", "source_id", "s", "site", full, "rid", "t").count() == 0


def test_long_last_tags(spark):
    long = "x/" * 150
    values = [
        f'It is a complete sentence. <a href="https://{long}">', f'It is a complete sentence. <img src="https://{long}', "It is a complete sentence." + "</p> <br/>" * 40,
        f'<img src="{long}"> ' + "Words go on. " * 20 + "And there.", "a < b and so " + "on it goes " * 30 + "there.",
    ]
    df = spark.createDataFrame(list(enumerate(values)), "id long, s string").selectExpr("id", "1L as source", "s", "'Site' as site")
    got = {r["key"]: (r["core"][-9:], r["ending"], r["mark"]) for r in tr.endings(df, "id", "source", "s", "site").collect()}
    assert got == {0: ("sentence.", "closed", ""), 1: ("sentence.", "closed", "broken"), 2: ("sentence.", "closed", ""), 3: ("nd there.", "closed", ""), 4: ("es there.", "closed", "")}


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(5.0, 0.5, 20_000))
    exact = {}
    for v in x[x < 150].astype(int):
        exact[v] = exact.get(v, 0) + 1
    mu, sd = tr.censored_fit(exact, 150, int((x >= 150).sum()))
    assert abs(mu - 5.0) < 0.05 and abs(sd - 0.5) < 0.05


def test_limits_of_small_share_and_several_of_one_source():
    rng = np.random.default_rng(3)
    lengths = np.exp(rng.normal(5.2, 0.6, 2000)).astype(int).clip(5)
    plain = np.arange(1, lengths.max() + 1)
    n = np.bincount(lengths, minlength=len(plain) + 1)[1:]
    loose = np.zeros(len(plain) * 2, bool)
    loose[len(plain) :] = True
    open_ = np.bincount(lengths[:100], minlength=len(plain) + 1)[1:]  # values without a full stop, at any length
    assert tr._limits(np.tile(plain, 2), np.concatenate([n, open_]), loose) == []
    open_[[119, 299]] += [60, 40]
    (a, wa), (b, wb) = sorted(tr._limits(np.tile(plain, 2), np.concatenate([n, open_]), loose))
    assert 120 <= a <= 121 and 300 <= b <= 301 and wa == wb == 3  # a chance value beside the pile may be taken with it


def test_ratios_are_learnt_from_the_posteriors():
    counts = [("open on", 0.99, 300), ("open 1", 0.99, 200), ("open 1", None, 5), ("open 2", None, 90), ("open 2", 0.5, 4), ("open on", None, 6), ("whole", None, 2000), ("cut", None, 10)]
    ratios, share = tr.likelihood_ratios(counts)
    assert ratios["open on"] > 4 and ratios["open 1"] > 4 and ratios["open 2"] < 0 and share < 0.05
    assert tr.likelihood_ratios([])[0] == {}


def test_without_posteriors_cuts_are_lost(spark, monkeypatch):
    """Without full texts the censoring posterior carries the decision."""
    rows = [(k, 1 + k % 2, sentences(k)[: 60 if k % 2 == 0 else None].rstrip(), "Site") for k in range(300)]
    df = spark.createDataFrame(rows, "id long, source_id long, s string, site string")
    none = spark.createDataFrame([], "rid long, t string")
    cut_ = lambda: {r["id"] for r in tr.truncated(df, "id", "source_id", "s", "site", none, "rid", "t").where("truncated").collect()}
    got = cut_()
    assert len([k for k in got if k % 2 == 0]) > 130 and not [k for k in got if k % 2]
    fit = tr.fit_source
    monkeypatch.setattr(tr, "fit_source", lambda h: fit(h).assign(posterior=float("nan")))
    assert len(cut_()) < 15


PAGE = """<html><head><title>Head {k} | Site</title><style>p{{}}</style></head><body><nav><a>Home</a> <a>World</a></nav>
<div style="display:none"><p>Hidden text {k} is here.</p></div><!-- <p>No.</p> --><article><h1>Head {k}</h1><p>Story {a} begins <b>well</b> &amp; goes on.</p>
<p>Advertisement. The story continues below.</p><p>Second part {b} of the story ends here.</p><figure><figcaption>A caption {k} stands alone.</figcaption></figure></article>
<aside><p>Teaser {k}. It tells of another thing {c}.</p></aside><footer><p>© 2025 Site. All rights reserved.</p></footer></body></html>"""


def page(k):
    w = ["red", "blue", "green", "white", "black", "brown", "grey"]
    return PAGE.format(k=k, a=w[k % 7] + "er", b=w[(k + 2) % 7] + "ish", c=w[(k + 4) % 7])


def test_bodies(spark):
    rows = [(k, "raw_html", "site.example", "Site", page(k)) for k in range(12)]
    rows += [(100 + k, "clean_text", "site.example", "Site", f"Home · World\nStory {k} of its own words alone{k}.\nAdvertisement. The story continues below.\n© 2025 Site. All rights reserved.") for k in range(5)]
    rows += [(900, "raw_html", None, None, "<p>Broken <div>markup without end."), (901, "clean_text", "x", None, ""), (902, "raw_html", "x", None, None), (903, "clean_text", "x", "X", "Long. " * 3000)]
    out = bp.body_blocks(spark.createDataFrame(rows, "id long, field string, host string, site string, content string"))
    got = {}
    for r in out.collect():
        got.setdefault((r["id"], r["field"]), set()).add(r["block_md5"])
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for k in range(12):
        p = bp.read_page(page(k))
        story = [b.text for b in p.blocks if b.text.startswith(("Story", "Second"))]
        assert got[(k, "raw_html")] == {md5(t) for t in story} and "&" in story[0]
    assert all(got[(100 + k, "clean_text")] == {md5(f"Story {k} of its own words alone{k}.")} for k in range(5))
    assert (901, "clean_text") not in got and (902, "raw_html") not in got
    assert bp.body_blocks(out.select("id", "field", F.lit("h").alias("host"), F.lit("s").alias("site"), F.lit(None).cast("string").alias("content"))).count() == 0


def test_notices_of_a_sharded_host(spark, monkeypatch):
    """A notice on a few pages of a large host goes, a story delivered again in other shards stays."""
    monkeypatch.setattr(bp, "SHARD_BYTES", 600)  # some three pages
    notice = "Readers of this host may write to the desk at any hour."
    again = "A long story came again and again " + "with ever the same words of its own and with nothing left out of it, " * 3 + "and so on."
    own = lambda k, n: " ".join("".join(chr(97 + int(c, 16)) for c in hashlib.md5(f"{k} {j}".encode()).hexdigest()[:7]) for j in range(n))
    texts = {k: f"{own(k, 12)}.\n{own(-1 - k, 9)}." for k in range(60)}
    rows = [(k, "clean_text", "big.example", None, t + ("\n" + notice if k % 6 == 0 else "")) for k, t in texts.items()]
    # delivered again, its other paragraph with a word changed
    rows += [(100 + k, "clean_text", "big.example", None, again + "\n" + own(500, 25) + f" word{'abcdef'[k]}.") for k in range(6)]
    # no headline: the notices weigh more than the story until they are known as such
    rows += [(200 + k, "raw_html", "big.example", None, f"<div><p>Short {w} tale.</p><p>End {w}.</p></div><div><p>{notice}</p><p>{notice}</p></div>") for k, w in enumerate(("qq", "rr"))]
    got = {}
    for r in bp.body_blocks(spark.createDataFrame(rows, "id long, field string, host string, site string, content string")).collect():
        got.setdefault(r["id"], set()).add(r["block_md5"])
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert not any(md5(notice) in v for v in got.values())
    assert all(md5(again) in got[100 + k] for k in range(6))
    assert got[200] == {md5("Short qq tale."), md5("End qq.")} and got[0] == {md5(x) for x in texts[0].split("\n")}


def chosen(pages):
    import pandas as pd

    out = bp.host_blocks(pd.DataFrame(pages, columns=["id", "field", "site", "content"]))
    return set(out[out["choice"].notna()][["id", "md5"]].itertuples(index=False, name=None))


def test_the_suffix_array_decides(monkeypatch):
    """A notice inside the story's element, and standing lines of texts, go by the array alone: without it they stay."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    notice, line = "Advertisement. The story continues below.", "Readers may write to the desk at any hour."
    pages = [(k, "raw_html", "Site", page(k)) for k in range(7)]
    pages += [(100 + k, "clean_text", "Site", f"Story {w} of its own words.\n{line}") for k, w in enumerate(("red", "blue", "green", "white"))]
    got = chosen(pages)
    assert not {(k, md5(notice)) for k in range(7)} & got and not {(100 + k, md5(line)) for k in range(4)} & got
    monkeypatch.setattr(bp, "repeats", lambda tokens, *_: np.zeros(len(tokens), np.int64))
    blind = chosen(pages)
    assert got < blind and {(k, md5(notice)) for k in range(7)} <= blind and {(100 + k, md5(line)) for k in range(4)} <= blind


def test_prose_without_terminal_marks():
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    thai = ["รัฐบาลประกาศแผนการก่อสร้างโรงเรียนใหม่ในจังหวัดภาคเหนือเมื่อวานนี้ และจะเริ่มงานในปีหน้า", "ชาวบ้านในพื้นที่บอกว่าพวกเขารอคอยโครงการนี้มานานหลายปีแล้ว และหวังว่าจะสำเร็จ"]
    html = f"<title>ข่าวใหม่</title><nav>หน้าแรก ข่าว กีฬา</nav><article><h1>ข่าวใหม่</h1><p>{thai[0]}</p><p>{thai[1]}</p></article>"
    lead = "The council will decide three things at its next meeting:"
    listed = f"<title>Plans</title><article><h1>Plans</h1><p>By A Writer</p><p>It met on Monday.</p><p>{lead}</p><ul><li>the new bridge</li><li>the old school</li></ul><p>It ends there.</p></article><ul><li>Sport</li></ul>"
    text = f"Plans\n{lead}\n- the new bridge\n- the old school\nShare this"
    assert chosen([(1, "raw_html", "S", html)]) == {(1, md5(t)) for t in thai}
    assert chosen([(2, "raw_html", "S", listed)]) == {(2, md5(t)) for t in ("It met on Monday.", lead, "the new bridge", "the old school", "It ends there.")}
    assert chosen([(3, "clean_text", "S", text)]) == {(3, md5(t)) for t in (lead, "- the new bridge", "- the old school")}


def test_a_notice_on_four_of_ten_thousand_pages(spark, monkeypatch):
    monkeypatch.setattr(bp, "SHARD_BYTES", 60_000)
    notice = "Correspondents of this paper may be reached through its desk in the harbour."
    word = lambda k, j: "".join(chr(97 + int(c, 16)) for c in hashlib.md5(f"{k} {j}".encode()).hexdigest()[:6])
    rows = [(k, "clean_text", "big.example", None, " ".join(word(k, j) for j in range(12)) + "." + (f"\n{notice}" if k % 2500 == 7 else "")) for k in range(10_000)]
    out = bp.body_blocks(spark.createDataFrame(rows, "id long, field string, host string, site string, content string"))
    assert out.count() == 10_000 and out.where(F.col("block_md5") == hashlib.md5(notice.encode()).hexdigest()).count() == 0


def test_repeats_against_brute_force():
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 4, 40).tolist() for _ in range(6)]
    tokens = np.array([t for k, p in enumerate(pages) for t in [*p, -1 - k]])
    page = np.repeat(np.arange(6), 41)
    got = bp.repeats(tokens, page, np.ones(len(tokens), bool), least=3, longest=16)
    text = tokens.tolist()
    for i in range(0, len(text), 5):
        n = 0
        while n < 16 and i + n < len(text) and len({page[j] for j in range(len(text) - n) if text[j : j + n + 1] == text[i : i + n + 1]}) >= 3:
            n += 1
        assert got[i] <= n
        if got[i] < n:  # copies of one page beside each other can hide a longer run
            assert n - got[i] <= 3


def test_runs_that_stand_often_on_each_page():
    rng = np.random.default_rng(8)
    pages = [[7, 8, 9, 7 if k < 2 else 6] * 6 + rng.integers(20, 24, 20).tolist() for k in range(5)]
    tokens = np.array([t for k, p in enumerate(pages) for t in [*p, -1 - k]])
    page = np.repeat(np.arange(5), [len(p) + 1 for p in pages])
    got = bp.repeats(tokens, page, np.ones(len(tokens), bool), least=3, longest=16)
    text = tokens.tolist()
    for i in range(len(text)):
        n = 0
        while n < 16 and i + n < len(text) and len({page[j] for j in range(len(text) - n) if text[j : j + n + 1] == text[i : i + n + 1]}) >= 3:
            n += 1
        assert min(got[i], 16) == n
