"""Sentence units of texts in many scripts (problem 10).

A line break always ends a unit. Within a line, every run of terminal marks that white space (or, in scripts without
spaces, any letter) can follow is a candidate; marks inside a quotation or brackets that stay open are none, since a
quotation belongs to the clause that reports it. A maximum-entropy classifier (logistic regression over indicator
features of the neighbouring tokens, case, length, digits, script, closing marks and what introduced a quotation)
decides each candidate. It is trained on reliable boundaries: a bounded sample of documents, where a mark at the end
of a line is a boundary and one before a lower-case letter is not, and a few sentences with marked boundaries for
every language. In Thai text a space ends a sentence.

Closing marks and quotes, and a list marker before a sentence, belong to it. Null and blank texts have no units. Texts
are handled whole, however long; repeated rows give repeated units; only `key` is kept of the other columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 2000
_LINE = re.compile("[^\n\r\x0b\x0c\x85  ]+")
_MARKS = re.compile(r"[.!?…。！？।॥؟۔．։።፧។៕။᙮]+")
_WIDE = frozenset("。！？．។៕။")
_MARKER = re.compile(r"\s*(?:\(?\d{1,3}[.)]|[A-Za-z][.)]|[•·*–-])\s+")
_BEFORE = re.compile(r"(?:\d+[.,:])*[^\s“”„«»‹›「」『』\"()\[\]（）—–,;:،؛]*$")
_NEXT = re.compile(r"\s*([—–-]?)\s*([“„«‹「『\"'‘(\[（¿¡]*)\s*(\w*)", re.UNICODE)
_THAI_SPACE = re.compile(r"(?<=[฀-๿])\s+|(?<!\s)\s+(?=[฀-๿])")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", '"': '"'}
_BRACKETS = {"(": ")", "（": "）", "[": "]", "【": "】"}
_ENCLOSING = re.compile("[" + re.escape("".join({*"".join(_PAIRS), *"".join(_PAIRS.values()), *_BRACKETS, *_BRACKETS.values()})) + "]")

# Training sentences with marked boundaries. ¶ stands where one ends; every other mark is inside.
SEED = """
Dr. Weller met Mr. Stone and Mrs. Stone at St. Anne's.¶ Prof. Hale left with Sen. Brook and Gov. Reed.¶ Ms. Gray stayed.
Fig. 3 and No. 12 show it, cf. p. 4, i.e. less than in vol. 2, e.g. here.¶ See also ch. 7, approx. 40 pages.
Acme Inc. and Brown Ltd. paid Dale Corp. about 3.5 million on Jan. 5, vs. 2.1 on Feb. 9.¶ The U.S. Senate met at 5 p.m. on Monday.
J. R. Smith wrote to A. B. Clark in Sept. and again in Dec. about it.¶ “Stop!” cried the guard as they ran.¶ “Why now? Nobody knows,” said a man.
She said: “We will wait.”¶ Then the doors opened.¶ Nobody moved!¶ Was it late?¶ It was 5.¶ They left…¶ All was quiet...¶ Rain fell.
El Dr. Soler y la Dra. Vega vieron al Sr. Luna y a la Sra. Paz en Sta. Elena.¶ Según el art. 12, pág. 4, es así.¶ La firma Roca S.A. pagó aprox. 30.
Abre a las 5 p. m. del lunes y cierra a las 9 a. m. del martes.¶ —¡Alto! —dijo el guardia.¶ «¿Por qué? Nadie sabe», dijo ella.¶ Añadió: «Esperamos».¶ Luego salió.
La jueza M. T. Rivas vive en la av. Colón, núm. 7, en EE. UU. desde ayer.¶ No habló más.
M. Dupont et Mme. Petit ont vu le Dr. Roy, MM. Blanc et Noir.¶ Selon l’art. 5, c.-à-d. moins, p. ex. ici, env. 40 pages.¶ La société Lune S.A. a payé.
À 17 h. 30 au plus tard, J. P. Martin viendra.¶ « Assez ! » a crié un homme.¶ « Pourquoi ? Personne ne sait », a dit Anne.¶ Elle a ajouté : « On attend. »¶ Puis tout cessa.
Elle habite av. Foch, bd. Nord, St. Jean, vol. 2, chap. 3, no. 8, fig. 4.¶ Rien de plus.
Dr. Meier und Prof. Lang trafen Hr. Kuhn und Fr. Beck in St. Ingbert.¶ Nach Abs. 3 und Art. 4, Nr. 12, d. h. weniger, z. B. hier, ca. 40 Seiten.
Am 3. März und am 12. Mai, am 1. Januar, am 30. Juni und am 7. Oktober kam er.¶ Im 2. Jahr und beim 4. Mal blieb er.¶ Die Mond Ltd. zahlte 3,5 Mio. Euro, u. a. für die Str. nach Nord.
Richter H. P. Vogel sprach.¶ „Halt!“, rief ein Mann.¶ „Warum? Niemand weiß es“, sagte sie.¶ Sie ergänzte: „Wir warten.“¶ Dann ging sie.¶ Es waren 41,7.¶ Mehr nicht.
Am 15. April, am 8. Februar, am 22. August, am 9. Juli, am 5. September, am 11. November, am 24. Dezember war es so.
O Dr. Lima e a Dra. Reis viram o Sr. Melo e a Sra. Dias em Sta. Rita.¶ Pelo art. 9, pág. 3, é assim.¶ A firma Sol Ltda. pagou aprox. 30 à Lua S.A. ontem.
“Basta!”, gritou um homem.¶ “Por quê? Ninguém sabe”, disse ela.¶ Ela disse: “Esperamos”.¶ Depois saiu.¶ O juiz P. R. Costa citou a av. Norte, núm. 5.
Судья А. Б. Орлов сослался на ст. 5 и п. 3.¶ Он живёт на ул. Лесной, д. 7, кв. 2, с 2020 г. вместе с г. Ивановым, т. е. давно.
В 9 ч. 15 мин. в среду у пл. Мира, пр. Ленина и им. Гоголя было 3 млн. руб. и 5 тыс. человек, и т. д. и т. п. на стр. 4.
Клиника им. Павлова и школа им. Лермонтова закрыты.¶ Врач Г. М. Соколов и И. О. Белов ушли.
Judge K. L. Moore, Judge D. K. Wood and M. J. K. Durand came.¶ Le juge B. K. Morel, la juge F. G. Simon et J. K. Faure sont venus.¶ Tout va bien.
— Хватит! — крикнул он.¶ «Почему? Никто не знает», — сказала она.¶ Она добавила: «Мы ждём».¶ Потом ушла.¶ — Стой! — сказал он.
डॉ. वर्मा और श्री. राव प्रा. लि. के सं. 12 पर मिले।¶ न्यायाधीश के. आर. नारायण और ए. बी. सिंह आए।¶ पं. मिश्र कि. मी. दूर थे।
“रुको!” एक आदमी चिल्लाया।¶ “क्यों? किसी को पता नहीं,” उसने कहा।¶ उसने कहा: “हम रुकेंगे।”¶ फिर वह गया।¶ काम रुक गया.¶ सब चले गए.¶ दाम गिरे!¶ कब?¶ बात टल गई.¶ जाँच हुई.¶ सबने साथ पाया.¶ उसने काम पूरा किया.¶ सब ठीक था.¶ पैसा दिया.¶ लोग आए हैं.¶ कीमत बढ़ी!¶ फिर क्या हुआ?¶ सब हँसे.
“बस!” गाँव के पास एक बच्चा बोला।¶ “चलो!” सड़क पर एक चालक ने कहा।¶ उसने बताया: “देर हो गई है।”¶ अगले दिन सब लौटे।¶ लागत बढ़ गई!¶ सोहन के निवासी रुके।¶ बारिश हुई!¶ बाज़ार में भीड़ थी।
قال د. سامي ود. منى إن شركة النور ش.م.م. دفعت 3 مليون.¶ زار أ. كريم م. هدى أمس.¶ صاح رجل: «كفى!» حين دخل.¶ «لماذا؟ لا أحد يعرف»، قالت.
وأضافت: «سننتظر».¶ ثم خرجت.¶ هتف سائق: «توقفوا!» عندما رآهم.¶ نادى طفل: «هيا!» قبل أن يجري.¶ انتهى العمل!¶ من جاء؟¶ لا أحد.¶ ارتفعت الأسعار!¶ قال الناس ذلك.¶ وعد بالعودة!¶ في المساء رحل.
他说：“我们等。”¶后来他走了。¶“够了！”门口的一个人喊道。¶“为什么？没人知道。”一名店员说。¶她补充说：「时间不多。」¶随后会议结束。¶王博士（A. B.）来了。¶结束了！¶谁来？¶下雨了…¶天黑了……¶他们回家。
“快走！”路边的司机叫道。¶“谁去？我不去。”老师说。¶市长说：「还有三天。」¶周一，大家同意了。
「待って！」と男が叫んだ。¶「なぜですか。だれも知りません。」と店員は話した。¶市長は「時間がある。」と述べた。¶会議は終わった。¶雨だ！¶だれですか？¶静かだ…¶夜になった……¶朝が来た。
「早く！」と子どもが言った。¶彼女は「もう遅い。」と付け加えた。¶先生（A. B.）は来た。¶「だれ？」と彼は聞いた。
Նա եկավ։¶ Մենք գնացինք տուն։¶ Ի՞նչ եղավ այնտեղ։¶ Ոչինչ։¶ Հետո նրանք խոսեցին։
እሱ መጣ።¶ እኛ ወደ ቤት ሄድን።¶ ማን አለ፧¶ ማንም የለም።¶ ከዚያ ተነሱ።
គាត់មក។¶ យើងទៅផ្ទះ។¶ គ្មានអ្វីទេ។¶ពួកគេនិយាយ។
သူလာသည်။¶ ငါတို့အိမ်သွားသည်။¶ ဘာမှမရှိပါ။¶သူတို့ပြောသည်။
"""


def _spans(line: str) -> tuple[list[tuple[int, int, bool]], set[int]]:
    """Quotations and brackets of a line as (start, end, is a quotation after a colon); the places of closing marks."""
    out, stack = [], []
    for m in _ENCLOSING.finditer(line):
        c, p = m[0], m.start()
        if stack and c in stack[-1][1]:
            q, _, quote = stack.pop()
            out.append((q, p, quote and line[:q].rstrip()[-1:] in (":", "：")))
        elif c in _PAIRS:
            stack.append((p, _PAIRS[c], True))
        elif c in _BRACKETS:
            stack.append((p, _BRACKETS[c], False))
        else:
            for k in range(len(stack) - 1, -1, -1):  # something inside was never closed
                if c in stack[k][1]:
                    out.append((stack[k][0], p, stack[k][2] and line[: stack[k][0]].rstrip()[-1:] in (":", "：")))
                    del stack[k:]
                    break
    return out, {b for _, b, _ in out}


def _script(c: str) -> str:
    o = ord(c) if c else 0
    for name, low, high in (("latin", 0x41, 0x24F), ("cyrillic", 0x400, 0x52F), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("armenian", 0x530, 0x58F), ("thai", 0xE00, 0xE7F), ("myanmar", 0x1000, 0x109F), ("ethiopic", 0x1200, 0x139F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF)):
        if low <= o <= high:
            return name
    return "other"


def _shape(token: str) -> str:
    if token.isdigit():
        return "int" if len(token) <= 2 else "number"
    if token[:1].isdigit():
        return "decimal" if re.search("[.,:]", token) else "mixed"
    return "dotted" if "." in token else "upper" if token[:1].isupper() else "word" if token.isalpha() else "mixed"


def candidates(line: str) -> Iterator[tuple[int, tuple]]:
    """(end, key): places in a line where a sentence may end; key has all that the classifier looks at."""
    marker = _MARKER.match(line)
    first = marker.end() if marker else 0
    spans, closing = _spans(line) if _ENCLOSING.search(line) else ((), ())
    n = len(line)
    for m in _MARKS.finditer(line, first):
        p, e = m.start(), m.end()
        if e < n and m[0] == "." and not line[e].isspace() and e not in closing:
            continue
        colon = quoted = bracket = False
        end = e
        while end < n:
            at = end + 1 if line[end] in "   " and line[end + 1 : end + 2] == "»" else end
            if at not in closing:
                break
            for a, b, c in spans:
                if b == at:
                    colon, quoted, bracket = colon or c, quoted or line[b] not in ")）]】", bracket or line[b] in ")）]】"
            end = at + 1
        if spans and any(a < p < b and b >= end for a, b, _ in spans):
            continue
        if end >= n or not line[end:].strip():
            return
        mark = m[0][-1]
        spaced = line[end].isspace()
        if not spaced and not (mark in _WIDE or mark == "…" and _script(line[end]) in ("han", "kana", "other")):
            continue
        nx = _NEXT.match(line, end)
        word = nx[3]
        c = word[:1]
        case = "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else _script(c) if c else "mark"
        before = _BEFORE.search(line, max(first, p - 24), p)[0]
        sort = "dot" if m[0] == "." else "rest" if len(m[0]) > 1 or mark == "…" else mark
        state = "colon" if colon else "quoted" if quoted else "bracket" if bracket else ""
        yield end, (before, sort, state, bool(nx[1]), bool(nx[2]), case, word[:1] if case in ("han", "kana") else word[:12])


def features(key: tuple) -> list[str]:
    before, sort, state, dash, opens, case, word = key
    shape, size = _shape(before), min(len(before), 6)
    low = before.lower()
    return [
        "bias", f"w {low} {sort}", f"n {word.lower()}", f"size {size} {sort}", f"shape {shape} {sort}", f"case {case} {dash}", f"sort {sort} {case} {state}", f"suffix {low[-2:]} {sort} {size > 3}",
        f"state {state} {sort}", f"state {state} {case}", f"state {state} {word if case == 'kana' else ''}", f"shape {shape} {case} {sort}", f"script {_script(before[-1:])} {sort}", f"size {size} {shape} {case} {sort}", f"opens {opens} {dash} {case}",
    ]


def _examples(texts: list[str]) -> Iterator[tuple[tuple, int, float]]:
    """(key, label, weight) from documents' reliable boundaries and from SEED."""
    for text in texts:
        lines = [x.strip() for x in _LINE.findall(text)]
        for line, after in zip(lines, [*lines[1:], ""]):
            for _, key in candidates(line):
                if key[5] == "lower":
                    yield key, 0, 1.0
            if after and _MARKS.search(line[-3:]) and not _MARKER.match(after):
                joined = f"{line} {after}"
                for end, key in candidates(joined):
                    if end == len(line) and key[5] != "lower":
                        yield key, 1, 1.0
    for line in SEED.strip().split("\n"):
        if "¶" not in line:
            continue
        plain, ends = "", set()
        for part in line.split("¶"):
            plain += part
            ends.add(len(plain))
        for end, key in candidates(plain):
            yield key, int(end in ends), 3.0


def train(texts: list[str], rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> dict[str, float]:
    """Weights of the features, by logistic regression with per-feature step sizes."""
    names: dict[str, int] = {}
    rows, labels, weights = [], [], []
    for key, label, weight in _examples(texts):
        rows.append([names.setdefault(f, len(names)) for f in features(key)])
        labels.append(label)
        weights.append(weight)
    x, y, v = np.array(rows), np.array(labels, float), np.array(weights)
    v = v * np.where(y == 1, v[y == 0].sum() / v[y == 1].sum(), 1.0)  # both kinds weigh the same
    v /= v.sum()
    w, g2 = np.zeros(len(names)), np.full(len(names), 1e-12)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-w[x].sum(1)))
        g = np.bincount(x.ravel(), np.repeat((p - y) * v, x.shape[1]), len(names)) + decay * w / len(names)
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return dict(zip(names, w))


def units(text: str, decide) -> list[tuple[int, int]]:
    """(start, end) of the units of a text, as code point offsets; decide(key) says whether a candidate is a boundary."""
    out = []
    for m in _LINE.finditer(text):
        line, base = m[0], m.start()
        cuts = [end for end, key in candidates(line) if decide(key)]
        if any("฀" <= c <= "๿" for c in line):
            marker = _MARKER.match(line)
            spaces = [s.start() for s in _THAI_SPACE.finditer(line, marker.end() if marker else 0)]
            cuts = sorted({*cuts, *spaces})
        start = 0
        for end in [*cuts, len(line)]:
            piece = line[start:end]
            bare = piece.strip()
            if bare:
                a = base + start + len(piece) - len(piece.lstrip())
                out.append((a, a + len(bare)))
            start = end
    return out


def sample_texts(docs: DataFrame, key: str, text: str, size: int = SAMPLE_DOCS) -> list[str]:
    """At most `size` texts, chosen by the hash of their key."""
    keys = docs.select(F.col(f"`{key}`").alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(size)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(keys), "k").where("t is not null")
    return [r["t"] for r in rows.orderBy("k", "t").limit(size).collect()]


def sentences(docs: DataFrame, key: str, text: str, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(key, start_char, end_char): the units of every text."""
    weights = train(sample_texts(docs, key, text, sample))
    kind = docs.schema[key].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, bool] = {}

        def decide(k: tuple) -> bool:
            if k not in known:
                if len(known) > 200_000:
                    known.clear()
                known[k] = sum(weights.get(f, 0.0) for f in features(k)) > 0
            return known[k]

        for batch in batches:
            ids, starts, ends = [], [], []
            for k, t in zip(batch[key], batch["__text"]):
                if isinstance(t, str):
                    for a, b in units(t, decide):
                        ids.append(k)
                        starts.append(a)
                        ends.append(b)
            yield pd.DataFrame({key: pd.Series(ids, dtype=batch[key].dtype), "start_char": pd.Series(starts, dtype="int64"), "end_char": pd.Series(ends, dtype="int64")})

    plain = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))
    return plain.mapInPandas(split, f"`{key}` {kind}, start_char long, end_char long")
