"""Bring texts that look the same to one consistent spelling (problem 6).

Each token's letters are resolved to the scripts in which they could have been typed: a letter with a look-alike in
another script belongs to both, any other letter only to its own. The intersection of these sets over the token says
how it can be spelled consistently: one script left means a mixed token is repaired to that script; several scripts
left means a whole-script confusable, which takes the script of the rest of the text, or Latin where nothing decides;
none left means a really mixed token, whose ambiguous letters follow the majority of its other letters. Before and
after that, width and presentation forms, ligatures, composition, invisible characters and kinds of space are
normalised. Case, accents, words and punctuation are kept.

Null stays null; an empty text stays empty; long texts are handled whole; the result depends on the text only, so
repeated rows agree.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import written

# Letters that look alike, as Latin, Cyrillic, Greek, Armenian, Cherokee; - where a script has none.
LOOKALIKES = (
    "A А Α - Ꭺ,B В Β - Ᏼ,C С - - Ꮯ,D - - - Ꭰ,E Е Ε - Ꭼ,G - - - Ꮐ,H Н Η - Ꮋ,I І Ι - -,J Ј - - Ꭻ,K К Κ - Ꮶ,L - - Լ Ꮮ,M М Μ - Ꮇ,N - Ν - -,"
    "O О Ο Օ -,P Р Ρ - Ꮲ,R - - - Ꭱ,S Ѕ - Տ Ꮪ,T Т Τ - Ꭲ,U - - Ս -,V - - - Ꮩ,W - - - Ꮃ,X Х Χ - -,Y У Υ - -,Z - Ζ - Ꮓ,"
    "a а - - -,c с - - -,d ԁ - - -,e е - - -,g - - ց -,h һ - հ -,i і - - -,j ј - յ -,n - - ո -,o о ο օ -,p р ρ - -,q ԛ - զ -,s ѕ - - -,u - υ ս -,v ѵ ν - -,w ԝ - - -,x х - - -,y у - - -"
)
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE")
# Letters of one script that look alike in print, each with the letter used for it.
SAME_SCRIPT = {"ک": "ك", "ی": "ي", "ھ": "ه", "ە": "ه"}

_INVISIBLE = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]"
)
_SPACE = re.compile("[\t\n\r\v\f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_FORMS = re.compile("[\uf900-\ufaff\ufb00-\ufdff\ufe10-\ufe1f\ufe30-\ufe6f\ufe70-\ufefc\uff01-\uffee]+[\u3099\u309a]?")
_TOKEN = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")


@lru_cache
def _table() -> tuple[dict[str, int], list[tuple[str, ...]]]:
    rows = [tuple(x.split()) for x in LOOKALIKES.split(",")]
    return {c: k for k, row in enumerate(rows) for c in row if c != "-"}, rows


@lru_cache(maxsize=65536)
def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


@lru_cache(maxsize=65536)
def _scripts_of(c: str) -> frozenset[str]:
    of, rows = _table()
    if c in of:
        return frozenset(s for s, x in zip(SCRIPTS, rows[of[c]]) if x != "-")
    return frozenset({_script(c)})


def _respell(token: str, script: str) -> str:
    of, rows = _table()
    k = SCRIPTS.index(script)
    return "".join(rows[of[c]][k] if c in of and rows[of[c]][k] != "-" else c for c in token)


def _resolve(token: str) -> tuple[frozenset[str], str]:
    """The scripts in which the whole token can be spelled, and the majority script of its unambiguous letters."""
    common: frozenset[str] | None = None
    sure: dict[str, int] = {}
    for c in token:
        if unicodedata.combining(c):
            continue
        own = _scripts_of(c)
        common = own if common is None else common & own
        if len(own) == 1:
            s = next(iter(own))
            sure[s] = sure.get(s, 0) + 1
    return common or frozenset(), max(sorted(sure), key=lambda s: sure[s], default="")


def consistent_form(text: str | None) -> str | None:
    if text is None or text.isascii() and text.isprintable() and text == text.strip():
        return text
    text = _INVISIBLE.sub("", _SPACE.sub(" ", text))
    text = _FORMS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    text = unicodedata.normalize("NFD", text)
    for a, b in SAME_SCRIPT.items():
        text = text.replace(a, b)
    if not any(c > "ͯ" and _script(c) in SCRIPTS for c in text):
        # only Latin letters, or none of the three scripts: nothing is confusable across scripts
        return unicodedata.normalize("NFC", text).strip()
    tokens = {t: _resolve(t) for t in set(_TOKEN.findall(text))}
    votes: dict[str, int] = {}
    for t in _TOKEN.findall(text):
        common, major = tokens[t]
        script = next(iter(common)) if len(common) == 1 else "" if common else major
        if script in SCRIPTS:
            votes[script] = votes.get(script, 0) + 1
    context = max(sorted(votes), key=lambda s: votes[s], default="LATIN")

    def spell(m: re.Match) -> str:
        common, major = tokens[m[0]]
        if common:
            script = next(iter(common)) if len(common) == 1 else context if context in common else "LATIN"
        else:
            script = major
        return _respell(m[0], script) if script in SCRIPTS else m[0]

    return unicodedata.normalize("NFC", _TOKEN.sub(spell, text)).strip()


@F.pandas_udf(T.StringType())
def _consistent_udf(texts: pd.Series) -> pd.Series:
    return texts.map(consistent_form, na_action="ignore")


def consistent(text: Column) -> Column:
    """The consistent form of a text column."""
    return _consistent_udf(text)


def lookalike_variants(df: DataFrame, key: str, text: str) -> DataFrame:
    """(form, variant): the distinct spellings of every form that occurs in more than one."""
    spelt = df.select(F.col(f"`{text}`").alias("variant")).where("variant is not null").distinct()
    spelt = written(spelt.select("variant", consistent(F.col("variant")).alias("form")).where("form <> ''"), "spellings")  # once for both uses
    many = spelt.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    return spelt.join(many, "form", "left_semi").select("form", "variant")


def lookalike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of `df` whose texts look the same but are not the same characters.

    Spellings are paired first and rows joined to them afterwards, so rows with one and the same text, however many,
    are never compared with each other. Null and blank texts take no part.
    """
    spelt = written(lookalike_variants(df, key, text), "variants")
    pairs = spelt.alias("a").join(spelt.alias("b"), "form").where("a.variant <> b.variant")
    pairs = pairs.select(F.col("a.variant").alias("va"), F.col("b.variant").alias("vb"))
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("v"))
    left = pairs.join(rows, pairs.va == rows.v).select(F.col("id").alias("id_a"), "vb")
    both = left.join(rows, left.vb == rows.v).where("id_a < id")
    return both.select("id_a", F.col("id").alias("id_b")).distinct()
