"""Language of documents and of same-language stretches, with a confidence (problem 1).

Hierarchical discrimination over hashed character pairs, triples and scripts: one linear machine for each language family (against the
rest) finds the family, then one-versus-one linear support vector machines separate the languages within it. All
machines are columns of one weight table, so a whole batch of texts is scored by table look-ups in numpy.

The machines are trained here: on a few sentences of every language, and on a bounded sample of labelled rows
(SAMPLE_ROWS texts and as many titles, chosen by the hash of their key). Labels are dirty, so machines trained on the
sentences alone first go over the sample, and rows whose label they contradict are left out.

A text is cut at line breaks and terminal marks; each sentence gets a language, units that are no full sentence take
that of the text next to them, and neighbours of the same language make a stretch. Null, empty and letterless texts
get no language. Texts are scored whole, however long. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.confusables import consistent_form

SAMPLE_ROWS = 2000
BUCKETS = 1 << 15
CHUNK = 300_000
UNSURE = 0.6
DOUBT = 0.4
# The families. A language that isn't listed is a family of its own.
FAMILIES = {"es": "romance", "fr": "romance", "pt": "romance", "en": "germanic", "de": "germanic", "zh": "east asian", "ja": "east asian"}
# Training sentences.
SEED = {
    "en": "The people of the town have been waiting for a long time and they do not know what will happen next. It was one of those things which nobody could explain. She said that he would be there before noon. After the meeting, most of them went home with their children. More than twenty were injured as the storm hits. How the city lost its case over old roads. Why are workers worried about the new plan?",
    "es": "La gente de la ciudad ha esperado mucho tiempo y no sabe lo que va a pasar después. Era una de esas cosas que nadie podía explicar. Ella dijo que él estaría allí antes del mediodía. Después de la reunión, la mayoría se fue a casa con sus hijos. Hay más de veinte heridos tras la tormenta. Cómo perdió la ciudad el caso de los viejos caminos. Por qué están preocupados los trabajadores por el nuevo plan?",
    "fr": "Les gens de la ville ont attendu longtemps et ne savent pas ce qui va se passer ensuite. C’était une de ces choses que personne ne pouvait expliquer. Elle a dit qu’il serait là avant midi. Après la réunion, la plupart sont rentrés chez eux avec leurs enfants. On compte plus de vingt blessés après la tempête. Comment la ville a perdu le procès sur les vieilles routes. Pourquoi les ouvriers s’inquiètent-ils du nouveau plan ?",
    "de": "Die Leute in der Stadt haben lange gewartet und wissen nicht, was als Nächstes geschehen wird. Es war eines dieser Dinge, die niemand erklären konnte. Sie sagte, dass er vor dem Mittag dort sein werde. Nach der Sitzung gingen die meisten mit ihren Kindern nach Hause. Es gibt mehr als zwanzig Verletzte nach dem Sturm. Wie die Stadt den Streit um alte Wege verlor. Warum sorgen sich die Arbeiter über den neuen Plan?",
    "pt": "As pessoas da cidade esperaram muito tempo e não sabem o que vai acontecer depois. Era uma daquelas coisas que ninguém conseguia explicar. Ela disse que ele estaria lá antes do meio-dia. Depois da reunião, a maioria foi para casa com os seus filhos. São mais de vinte feridos após a tempestade. Como a cidade perdeu a ação sobre as velhas estradas. Por que os trabalhadores estão preocupados com o novo plano?",
    "hi": "शहर के लोग बहुत देर से इंतज़ार कर रहे हैं और उन्हें नहीं पता कि आगे क्या होगा। यह उन बातों में से एक थी जिसे कोई समझा नहीं सकता था। उसने कहा कि वह दोपहर से पहले वहाँ होगा। बैठक के बाद ज़्यादातर लोग अपने बच्चों के साथ घर चले गए।",
    "ar": "انتظر أهل المدينة وقتا طويلا ولا يعرفون ما الذي سيحدث بعد ذلك. كان ذلك من الأمور التي لم يستطع أحد أن يفسرها. قالت إنه سيكون هناك قبل الظهر. بعد الاجتماع ذهب معظمهم إلى بيوتهم مع أطفالهم.",
    "ru": "Жители города долго ждали и не знают, что будет дальше. Это была одна из тех вещей, которые никто не мог объяснить. Она сказала, что он будет там до полудня. После собрания большинство пошли домой со своими детьми.",
    "zh": "城里的人已经等了很久，不知道接下来会发生什么。这是一件谁也无法解释的事情。她说他会在中午之前到那里。会议结束后，大多数人带着孩子回家了。这个地区的居民对新计划表示担心。",
    "ja": "町の人々は長い間待っていて、次に何が起こるのか分かりません。それはだれにも説明できないことの一つだった。彼女は、彼が正午までにそこに着くだろうと言った。会議の後、ほとんどの人は子どもたちと家に帰った。新しい計画について住民が心配している。",
    "th": "ชาวเมืองรอคอยมานานและไม่รู้ว่าจะเกิดอะไรขึ้นต่อไป เป็นเรื่องหนึ่งที่ไม่มีใครอธิบายได้ เธอบอกว่าเขาจะไปถึงที่นั่นก่อนเที่ยง หลังการประชุมคนส่วนใหญ่กลับบ้านพร้อมกับลูก",
}
_CUT = re.compile("(?:(?<=[\\w\\d%”»)]{3})\\.|[!?…।؟۔]|\\.{2,})+[”\"’»“」』)\\]]*(?=\\s|$)[^\\S\n]*|[。！？]+[”\"’»」』）)]*[^\\S\n]*|\\s*\n\\s*")
_WIDE_LETTERS = ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF))
_MIXED = re.compile("[\u00ad\u0300-\u04ff\u2000-\u200f\u202f\u205f-\u2064\ufb00-\ufb06\ufeff-\uffef]")
_ACCENT = re.compile("(?<=[A-Za-z])[\u0300-\u036f]+")


def normal_label(label: Column, codes: list[str]) -> Column:
    """A stored label trimmed, lower-cased and without anything from the first - or _ on; null if not one of `codes`."""
    code = F.regexp_replace(F.lower(F.trim(label)), "[-_].*$", "")
    return F.when(code.isin(codes), code)


def _fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with a space for all that is no letter; weights of letters (a wide letter counts 3)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    low = c + 32 * (((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7)) | ((c >= 0x410) & (c <= 0x42F)))
    letter = ((low >= 97) & (low <= 122)) | ((low >= 0xC0) & ~((low >= 0x2000) & (low <= 0x303F)) & ~((low >= 0xFF00) & (low <= 0xFF20)) & (low != 0xFEFF) & (low != 0xD7) & (low != 0xF7))
    wide = np.zeros(len(low), bool)
    for a, b in _WIDE_LETTERS:
        wide |= (low >= a) & (low <= b)
    return np.where(letter, low, 32), letter + 2 * (letter & wide)


def _hashes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the pairs and of the triples of code points that start at each place, and of the place's script."""
    pad = np.concatenate([c, np.array([32, 32])])
    two = pad[:-2] * 1000003 ^ pad[1:-1] * 8191
    three = two * 31 ^ pad[2:] * 131071
    block = np.where((c >= 0x3040) & (c <= 0x9FFF), np.where(c < 0x3100, 0x60, 0x34), np.where(c < 0x250, 0, c >> 7 & 0x3FF))
    return (two ^ two >> 15) % BUCKETS, BUCKETS + (three ^ three >> 15) % BUCKETS, 2 * BUCKETS + np.where(c == 32, 0x3FF, block)


@dataclass
class Model:
    families: list[list[str]]  # the languages of each family
    pairs: list[tuple[str, str]]
    table: np.ndarray  # (2 * BUCKETS + 1024, machines): first the families, then the pairs
    scale: tuple[float, float] = (2.5, 0.0)  # of margins to log odds of being right, see `calibrated`

    def score(self, text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean machine outputs (a wide letter counts 3) and letters of the segments of `text` that begin at `starts`."""
        c, letters = _fold(text)
        two, three, block = _hashes(c)
        weight = np.maximum(letters, 1)
        out = np.add.reduceat((self.table[two] + self.table[three] + self.table[block]) * weight[:, None].astype(np.float32), starts, axis=0)
        n = np.add.reduceat(letters, starts)
        return out / np.maximum(n, 1)[:, None].astype(np.float32), n

    def decide(self, scores: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and margin of each row of scores."""
        k = len(self.families)
        fam = scores[:, :k]
        best = fam.argmax(1)
        second = np.partition(fam, -2, axis=1)[:, -2] if k > 1 else np.zeros(len(fam))
        margin = fam[np.arange(len(fam)), best] - second
        names = np.array([f[0] for f in self.families], object)[best]
        for j, languages in enumerate(self.families):
            rows = np.flatnonzero(best == j)
            if len(languages) < 2 or not len(rows):
                continue
            votes = {x: np.zeros(len(rows)) for x in languages}
            for m, (a, b) in enumerate(self.pairs):
                if a in votes and b in votes:
                    s = scores[rows, k + m]
                    votes[a] += (s > 0) + np.tanh(s) / 100  # the margin breaks a cycle
                    votes[b] += (s <= 0) - np.tanh(s) / 100
            order = np.array([votes[x] for x in languages])
            win = order.argmax(0)
            names[rows] = np.array(languages, object)[win]
            for m, (a, b) in enumerate(self.pairs):
                if a in votes and b in votes:
                    own = np.flatnonzero((names[rows] == a) | (names[rows] == b))
                    margin[rows[own]] = np.minimum(margin[rows[own]], np.abs(scores[rows[own], k + m]))
        return list(names), margin


def _fit(texts: list[str], labels: list[str], rounds: int = 40) -> Model:
    """Linear machines by sub-gradient descent on the hinge loss, all columns at once."""
    languages = sorted(set(labels))
    by: dict[str, list[str]] = {}
    for x in languages:
        by.setdefault(FAMILIES.get(x, x), []).append(x)
    families = [by[f] for f in sorted(by)]
    pairs = [p for f in families for p in combinations(f, 2)]
    of = {x: j for j, f in enumerate(families) for x in f}
    y = np.zeros((len(texts), len(families) + len(pairs)), np.float32)
    for i, x in enumerate(labels):
        y[i, : len(families)] = -1
        y[i, of[x]] = 1
        for m, (a, b) in enumerate(pairs):
            y[i, len(families) + m] = 1 if x == a else -1 if x == b else 0
    plus, minus = (y > 0).sum(0), (y < 0).sum(0)
    weight = np.where(y > 0, 1 / np.maximum(plus, 1), np.where(y < 0, 1 / np.maximum(minus, 1), 0)).astype(np.float32)

    joined = "\n".join(texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    c, letters = _fold(joined)
    used, place = np.unique(np.concatenate(_hashes(c)), return_inverse=True)
    place = place.reshape(3, -1)
    row = np.repeat(np.arange(len(texts)), np.diff([*starts, len(c)]))
    n = np.maximum(np.bincount(row, letters, len(texts)), 1).astype(np.float32)
    w = np.zeros((len(used), y.shape[1]), np.float32)
    g2 = np.full_like(w, 1e-10)
    cells = [place[h] * np.int64(len(texts)) + row for h in range(3)]
    cell, inverse = np.unique(np.concatenate(cells), return_inverse=True)
    times = np.bincount(inverse, np.tile(np.maximum(letters, 1), 3))
    at, who = (cell // len(texts)).astype(np.int64), (cell % len(texts)).astype(np.int64)
    x = (times / n[who]).astype(np.float32)
    order = np.argsort(who, kind="stable")
    at2, x2, begin = at[order], x[order], np.searchsorted(who[order], np.arange(len(texts)))
    first = np.searchsorted(at, np.arange(len(used)))
    for _ in range(rounds):
        s = np.add.reduceat(w[at2] * x2[:, None], begin, axis=0)
        d = np.where(y * s < 1, -y * weight, 0)
        g = np.add.reduceat(d[who] * x[:, None], first, axis=0) + 1e-6 * w
        g2 += g * g
        w -= 1.0 * g / np.sqrt(g2)
    table = np.zeros((2 * BUCKETS + 1024, y.shape[1]), np.float32)
    table[used] = w
    return Model(families, pairs, table)


def pieces(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, ends with a terminal mark) of the sentences and lines of a text."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        if m.end() > at:
            out.append((at, m.end(), not m[0].startswith(("\n", " ", "\r", "\t")) and "\n" not in m[0]))
        at = m.end()
    if at < len(text):
        out.append((at, len(text), False))
    return out


def bare(text: str) -> str:
    """Without accents on Latin letters."""
    return unicodedata.normalize("NFC", _ACCENT.sub("", unicodedata.normalize("NFD", text)))


def train(texts: list[tuple[str, str]], titles: list[tuple[str, str]], codes: list[str]) -> Model:
    """A model from (text, label) samples, whose labels may be wrong, and SEED."""
    seed = [(s, x) for x in codes if x in SEED for s in (SEED[x][a:b] for a, b, _ in pieces(SEED[x]))]
    # Thai has no terminal marks: one piece is the whole seed.
    sample: list[tuple[str, str, int]] = []
    for k, (text, label) in enumerate(texts):
        if label in codes:
            parts = pieces(text)
            sample += [(text[a:b], label, k) for a, b, _ in parts[:: max(1, len(parts) // 3)]]
    sample += [(t, x, len(texts) + k) for k, (t, x) in enumerate(titles) if x in codes]
    # titles come without accents as well
    sample += [(bare(t), x, k) for t, x, k in sample if k >= len(texts) and bare(t) != t]
    seed += [(bare(t), x) for t, x in seed if bare(t) != t]
    sample = [r for r in sample if any(c.isalpha() for c in r[0])]
    if not seed:
        if len({x for _, x, _ in sample}) < 2:
            raise ValueError("no languages to train on")
        return _fit([t for t, _, _ in sample], [x for _, x, _ in sample])
    model = _fit(*map(list, zip(*seed)), rounds=60)
    good: list[tuple[str, str]] = []
    for rounds in (25, 40):
        if not sample:
            break
        said = classify([t for t, _, _ in sample], model)
        known = {x for f in model.families for x in f}
        agree: dict[int, int] = {}
        for (_, x, k), (y, _, n) in zip(sample, said):
            agree[k] = agree.get(k, 0) + (n if x == y else -n)
        # of a row whose label holds for most of it, unsure sentences count as well; a passage in another language doesn't
        good = [(t, x) for (t, x, k), (y, m, _) in zip(sample, said) if x == y or x not in known or (agree[k] > 0 and m < UNSURE)]
        model = _fit(*map(list, zip(*(seed + good))), rounds=rounds)
    model.scale = calibrated(seed + good)
    return model


def calibrated(rows: list[tuple[str, str]]) -> tuple[float, float]:
    """(slope, offset) that turn a margin into the log odds of the language being right.

    A model of every other row says the language of the rows between; a logistic regression of being right on the
    margin, with Platt's targets so that nothing is certain, gives the two numbers. Few rows: those of `Model`."""
    own, other = rows[::2], rows[1::2]
    if len(rows) < 50 or len({x for _, x in own}) < 2:
        return Model.scale
    said = classify([t for t, _ in other], _fit([t for t, _ in own], [x for _, x in own], rounds=25))
    m = np.array([k for (x, k, _) in said if x is not None])
    right = np.array([x == y for (x, _, _), (_, y) in zip(said, other) if x is not None], float)
    n1, n0 = right.sum(), (1 - right).sum()
    target = np.where(right > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    at = np.array(Model.scale)

    def loss(x: np.ndarray) -> float:
        z = x[0] * m + x[1]
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(50):  # Newton's steps, halved until the loss falls
        p = 1 / (1 + np.exp(-np.clip(at[0] * m + at[1], -30, 30)))
        g = np.array([((p - target) * m).sum(), (p - target).sum()])
        w = p * (1 - p) + 1e-6
        step = np.linalg.solve(np.array([[(w * m * m).sum(), (w * m).sum()], [(w * m).sum(), w.sum()]]) + np.eye(2) * 1e-3, g)
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-6:
            break
    a, b = at
    return (float(a), float(b)) if np.isfinite(a) and np.isfinite(b) and a > 0 else Model.scale


_FITTED: dict[bytes, Model] = {}  # of this process, by what they were trained on


def trained(texts: list[tuple[str, str]], titles: list[tuple[str, str]], codes: list[str]) -> Model:
    """As `train`, but a model that was trained on the same samples in this process is used again."""
    seen = hashlib.blake2b(repr((texts, titles, codes)).encode("utf-8", "surrogatepass")).digest()
    if seen not in _FITTED:
        if len(_FITTED) >= 4:
            _FITTED.clear()
        _FITTED[seen] = train(texts, titles, codes)
    return _FITTED[seen]


def save(model: Model, path: str) -> None:
    """A trained model as one file of arrays, for jobs that don't train their own."""
    np.savez_compressed(path, table=model.table, names=np.array([json.dumps([model.families, model.pairs, model.scale])]))


def load(path: str) -> Model:
    with np.load(path) as f:
        families, pairs, scale = json.loads(str(f["names"][0]))
        return Model(families, [tuple(p) for p in pairs], f["table"], tuple(scale))


def classify(texts: list[str], model: Model) -> list[tuple[str | None, float, int]]:
    """(language, margin, letters) of each text as one unit."""
    out: list[tuple[str | None, float, int]] = []
    k = 0
    while k < len(texts):
        size, e = 0, k
        while e < len(texts) and (e == k or size + len(texts[e]) < CHUNK):
            size += len(texts[e]) + 1
            e += 1
        part = texts[k:e]
        starts = np.cumsum([0, *(len(t) + 1 for t in part[:-1])])
        scores, letters = model.score("\n".join(part) + "\n", starts)
        names, margins = model.decide(scores)
        out += [(n if c else None, float(m), int(c)) for n, m, c in zip(names, margins, letters)]
        k = e
    return out


def confidence(margin: float, scale: tuple[float, float] = Model.scale) -> float:
    return round(float(1 / (1 + np.exp(-np.clip(scale[0] * margin + scale[1], -30, 30)))), 4)


def stretches(text: str, parts: list[tuple[int, int, bool]], said: list[tuple[str | None, float, int]]) -> list[tuple[int, int, str, float, int]]:
    """(start, end, language, margin, letters) of the same-language stretches of a text."""
    full = [f and n >= 24 and x is not None for (_, _, f), (x, _, n) in zip(parts, said)]
    if not any(full):  # headings and fragments only: the language of most letters
        votes: dict[str, int] = {}
        for x, _, n in said:
            if x:
                votes[x] = votes.get(x, 0) + n
        if not votes:
            return []
        best = max(sorted(votes), key=lambda x: votes[x])
        margin = max((m for x, m, _ in said if x == best), default=0.0)
        return [(0, len(text), best, margin, sum(n for _, _, n in said))]
    lang: list[str | None] = [x if f else None for f, (x, _, _) in zip(full, said)]
    # an unsure sentence speaks the language of the sentence before it, or of the one after it
    sure = [k for k, f in enumerate(full) if f]
    firm = [k for k in sure if said[k][1] >= DOUBT] or sure
    kept = set(firm)
    lang = [x if k in kept else None for k, x in enumerate(lang)]
    last = lang[firm[0]]
    for k, x in enumerate(lang):
        last = lang[k] = x or last
    out: list[list] = []
    for (a, b, _), x, (y, m, n) in zip(parts, lang, said):
        if out and out[-1][2] == x:
            out[-1][1] = b
            out[-1][4] += n
            if y == x:
                out[-1][3] += m * n
                out[-1][5] += n
        else:
            out.append([a, b, x, m * n if y == x else 0.0, n, n if y == x else 0])
    return [(a, b, x, m / max(w, 1), n) for a, b, x, m, n, w in out]


def plain_title(title: str, site: str | None) -> str:
    """A title without the name of its site and with consistent letters."""
    if _MIXED.search(title):
        title = consistent_form(title) or ""
    if site and site in title:
        title = title.replace(site, " ")
    return title


def text_stretches(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, seg_no, start_char, end_char, lang, confidence, letters) for every same-language stretch of every text."""
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            texts = [t for t in batch["__text"] if isinstance(t, str)]
            keys = [k for k, t in zip(batch[key], batch["__text"]) if isinstance(t, str)]
            rows = []
            k = 0
            while k < len(texts):
                e, size = k, 0
                while e < len(texts) and (e == k or size + len(texts[e]) < CHUNK):
                    size += len(texts[e]) + 1
                    e += 1
                group = texts[k:e]
                parts = [pieces(t) for t in group]
                base = np.cumsum([0, *(len(t) + 1 for t in group[:-1])])
                starts = np.array([b + a for b, p in zip(base, parts) for a, _, _ in p], np.int64)
                if len(starts):
                    scores, letters = own.score("\n".join(group) + "\n", starts)
                    names, margins = own.decide(scores)
                    said = [(n if c else None, float(m), int(c)) for n, m, c in zip(names, margins, letters)]
                    at = 0
                    for j, (t, p) in enumerate(zip(group, parts)):
                        for no, (a, b, x, m, n) in enumerate(stretches(t, p, said[at : at + len(p)])):
                            rows.append((keys[k + j], no, a, b, x, confidence(m, own.scale), n))
                        at += len(p)
                k = e
            out = pd.DataFrame(rows, columns=[key, "seg_no", "start_char", "end_char", "lang", "confidence", "letters"])
            yield out.astype({key: batch[key].dtype, "seg_no": "int32", "start_char": "int64", "end_char": "int64", "letters": "int64", "confidence": "float64"})

    plain = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))
    return plain.mapInPandas(run, f"`{key}` {kind}, seg_no int, start_char long, end_char long, lang string, confidence double, letters long")


def title_languages(df: DataFrame, key: str, title: str, site: str, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, lang, confidence) for every title that has letters; `site` names the column with its site's name."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            there = [k for k, t in enumerate(batch["__text"]) if isinstance(t, str)]
            texts, sites = list(batch["__text"]), [s if isinstance(s, str) else None for s in batch["__site"]]
            said = dict(zip(there, classify([plain_title(texts[k], sites[k]) for k in there], own)))
            good = [k for k in there if said[k][0]]
            out = {c: [batch[c].iloc[k] for k in good] for c in (key, *keep)}
            yield pd.DataFrame(out | {"lang": [said[k][0] for k in good], "confidence": [confidence(said[k][1], own.scale) for k in good]}, dtype=object).astype({key: batch[key].dtype, "confidence": "float64"})

    plain = df.select(*[F.col(f"`{c}`").alias(c) for c in (key, *keep)], F.col(f"`{title}`").alias("__text"), F.col(f"`{site}`").alias("__site"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return plain.mapInPandas(run, f"{kinds}, lang string, confidence double")


def sample_rows(df: DataFrame, key: str, text: str, label: str, size: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most `size` labelled texts, chosen by the hash of their key."""
    labelled = df.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    keys = labelled.select(F.col(f"`{key}`").alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(size)
    rows = labelled.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").alias("x")).join(F.broadcast(keys), "k")
    return [(r["t"], r["x"]) for r in rows.orderBy("k", "t", "x").limit(size).collect()]
