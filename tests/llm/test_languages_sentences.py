import pytest
from pyspark.sql import functions as F

from newsloom.llm import languages as lg
from newsloom.llm import sentences as sn

CODES = sorted(lg.SEED)


@pytest.fixture(scope="module")
def model():
    return lg.train([], [], CODES)


def test_held_out_accuracy(model):
    """Trained on half of the seed sentences, the machines know the other half."""
    texts = {x: [s for s in (lg.SEED[x][a:b] for a, b, _ in lg.pieces(lg.SEED[x]))] for x in CODES if x != "th"}
    train = [(s, x) for x, ss in texts.items() for s in ss[::2]]
    half = lg._fit([s for s, _ in train], [x for _, x in train])
    held = [(s, x) for x, ss in texts.items() for s in ss[1::2]]
    right = sum(y == x for (s, x), (y, _, _) in zip(held, lg.classify([s for s, _ in held], half)))
    assert right / len(held) >= 0.85


def test_wrong_labels_in_the_sample_are_left_out():
    texts = [("The people of the town are waiting. They do not know what will happen.", "en")] * 5 + [("Los vecinos de la ciudad esperan y no saben lo que va a pasar.", "en")] * 2
    m = lg.train(texts, [("Why are they worried about this", "en"), ("", "en"), ("123", "fr")], CODES)
    assert [x for x, _, _ in lg.classify(["Los vecinos de la ciudad no saben nada", "The people of the town", "12 34", ""], m)] == ["es", "en", None, None]


def test_confidence_follows_accuracy():
    """Rows of mixed words: the more of them are one language's, the surer; confidences are about the share that is right."""
    import random

    rng = random.Random(3)
    words = {x: lg.SEED[x].split() for x in ("en", "es", "de", "fr")}

    def row(x, noise):
        return " ".join(rng.choice(words[x if rng.random() > noise else rng.choice("en es de fr".split())]) for _ in range(rng.randint(1, 6)))

    rows = [(row(x, 0.4), x) for x in words for _ in range(250)]
    rng.shuffle(rows)
    scale = lg.calibrated(rows[:600])
    assert scale[0] > 0 and scale != lg.Model.scale
    said = lg.classify([t for t, _ in rows[600:]], lg._fit(*map(list, zip(*rows[:600])), rounds=25))
    sure = [lg.confidence(m, scale) for _, m, _ in said]
    right = [y == x for (y, _, _), (_, x) in zip(said, rows[600:])]
    assert abs(sum(sure) / len(sure) - sum(right) / len(right)) < 0.1
    assert lg.calibrated(rows[:20]) == lg.Model.scale


def test_a_model_is_saved_and_used_again(model, tmp_path):
    lg.save(model, str(tmp_path / "m.npz"))
    again = lg.load(str(tmp_path / "m.npz"))
    texts = ["The people of the town", "Los vecinos de la ciudad no saben nada", ""]
    assert lg.classify(texts, again) == lg.classify(texts, model) and again.scale == model.scale
    assert lg.trained([], [], CODES) is lg.trained([], [], CODES)


def test_stretches(spark, model):
    en, de = "The people of the town have been waiting for a long time.", "Die Leute in der Stadt haben lange gewartet und wissen nichts."
    rows = [(1, f"{en} {en}\n{de} {de}\nHome | Sport\n{en}"), (2, en), (3, None), (4, ""), (5, "123 456"), (6, "News"), (2, en)]
    out = lg.text_stretches(spark.createDataFrame(rows, "id long, t string"), "id", "t", model).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["seg_no"]):
        got.setdefault(r["id"], []).append(r["lang"])
        assert 0 <= r["confidence"] <= 1
    assert got[1] == ["en", "de", "en"] and got[2] == ["en", "en"] and 3 not in got and 4 not in got and 5 not in got


def test_titles(spark, model):
    rows = [(1, "Why the people are worried about the new plan | My Wire", "My Wire"), (2, "Warum sich die Menschen über den neuen Plan sorgen", None), (3, None, "x"), (4, "Wһу tһе реорlе аrе wоrrіеd", None)]
    df = spark.createDataFrame(rows, "id long, title string, site string")
    assert {r["id"]: r["lang"] for r in lg.title_languages(df, "id", "title", "site", model).collect()} == {1: "en", 2: "de", 4: "en"}


def test_labels(spark):
    df = spark.createDataFrame([(" EN-us ",), ("fr_CA",), ("xx",), ("",), (None,), ("--",)], "x string")
    assert [r[0] for r in df.select(lg.normal_label(F.col("x"), ["en", "fr"])).collect()] == ["en", "fr", None, None, None, None]


@pytest.fixture(scope="module")
def decide():
    w = sn.train([])
    return lambda k: sum(w.get(f, 0.0) for f in sn.features(k)) > 0


@pytest.mark.parametrize(
    "text, count",
    [
        ("Dr. Weller paid 3.5 million. Then Mr. Stone left!\nA heading\n\n1. First point here. Second one.", 5),
        ("“Stop!” cried the guard as they ran. She said: “We will wait.” Then it rained.", 3),
        ("他们回家。天黑了……“够了！”门口的一个人喊道。", 3), ("「待って！」と男が叫んだ。会議は終わった。", 2), ("— Хватит! — крикнул он. Судья А. Б. Орлов ушёл.", 2),
        ("ชาวเมืองรอคอย ไม่มีใครรู้", 2), ("", 0), (" \n\t\r\n", 0), ("no end", 1), ("...", 1),
    ],
)
def test_units(decide, text, count):
    units = sn.units(text, decide)
    assert len(units) == count
    assert all(text[a:b] == text[a:b].strip() and a < b for a, b in units)
    assert sum(len("".join(text[a:b].split())) for a, b in units) == len("".join(text.split()))  # nothing is lost


def test_sentences_frame(spark):
    rows = [(1, "One sentence. Another one here.", "x"), (2, None, "y"), (3, "", "z"), (4, "It rained. " * 5000, "w"), (1, "One sentence. Another one here.", "x")]
    out = sn.sentences(spark.createDataFrame(rows, "doc_id long, text string, start_char string"), "doc_id", "text")
    n = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 4, 4: 5000}
    assert sn.sentences(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
