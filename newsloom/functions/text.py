"""Text functions; native wherever Spark has the semantics, vectorised Python for Unicode forms and markup."""

from __future__ import annotations

import re
import unicodedata
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content is no prose, elements that end a block, and marks after which blocks join by a space.
SILENT = frozenset("script style noscript iframe svg".split())
BLOCKS = frozenset("p div br li ul ol tr td th table h1 h2 h3 h4 h5 h6 blockquote section article".split())
SENTENCE_ENDS = ".!?:;…”\"')]"


class _Unaccented(dict):
    """For str.translate: combining characters go, all others stay."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.combining(chr(code)) else code
        return self[code]


_UNACCENTED = _Unaccented()


def search_form(text: str | None) -> str | None:
    """Accents folded, lower case, everything but a-z, 0-9 and ' . - as single spaces."""
    if text is None:
        return None
    folded = text.lower() if text.isascii() else unicodedata.normalize("NFKD", text).translate(_UNACCENTED).lower()
    return " ".join(re.sub(r"[^a-z0-9'.\- ]+", " ", folded).split())


@F.pandas_udf(T.StringType())
def _search_form(texts: pd.Series) -> pd.Series:
    return texts.map(search_form, na_action="ignore")


def normalized(text: Column) -> Column:
    return _search_form(text)


def word_form(text: str | None) -> str | None:
    """The words of the search form, each between single spaces, so that whole words are found by containment."""
    if text is None:
        return None
    return f" {' '.join(re.findall('[a-z0-9_]+', search_form(text)))} "


@F.pandas_udf(T.StringType())
def _word_form(texts: pd.Series) -> pd.Series:
    return texts.map(word_form, na_action="ignore")


def worded(text: Column) -> Column:
    return _word_form(text)


class _Blocks(HTMLParser):
    """Collects the text of each block of a fragment."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = [""]
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag in BLOCKS:
            self.blocks.append("")

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if not self.silent:
            self.blocks[-1] += data


def blocks_of(fragment: str) -> list[str]:
    """The non-blank text blocks of a fragment of markup."""
    parser = _Blocks()
    parser.feed(fragment)
    parser.close()
    cleaned = (" ".join(unescape(b).split()) for b in parser.blocks)
    return [b for b in cleaned if b]


def without_markup(value: str | None) -> str | None:
    """Plain text of a feed excerpt; blocks join by a space after a sentence, else by a dash; null where nothing is left."""
    if not value or ("<" not in value and "&" not in value):
        return value
    joined = ""
    for block in blocks_of(value):
        joined += ("" if not joined else " " if joined[-1] in SENTENCE_ENDS else " — ") + block
    return re.sub(r"\s*(?:\.\.\.|…)\s*$", "…", joined) or None


@F.pandas_udf(T.StringType())
def _without_markup(values: pd.Series) -> pd.Series:
    return values.map(without_markup, na_action="ignore")


def strip_html(value: Column) -> Column:
    """Only values that hold markup go to Python."""
    return F.when(value.contains("<") | value.contains("&"), _without_markup(value)).otherwise(value)


@F.pandas_udf(T.StringType())
def _compatible(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _spaced_text(values: pd.Series) -> pd.Series:
    def plain(v: str) -> str:
        parser = _Blocks()
        parser.feed(v)
        parser.close()
        return " ".join(parser.blocks)

    return values.map(plain, na_action="ignore")


def distinct_sentences(text: Column, least: int = 20) -> Column:
    """Segments between '. ' of at least `least` characters, the first of each kept, joined again."""
    trimmed = F.transform(F.split(text, r"\. "), lambda s: F.regexp_replace(s, r"^\s+|\s+\z", ""))
    return F.array_join(F.array_distinct(F.filter(trimmed, lambda s: F.length(s) >= least)), ". ")


def cleaned(text: Column) -> Column:
    """Markup, links and tracking residue removed, white space collapsed, repeated sentences dropped, quotes made plain."""
    plain = F.when(text.contains("<") | text.contains("&"), _spaced_text(text)).otherwise(text)
    plain = F.regexp_replace(plain, r"https?://\S+", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[?&]utm_[^&\s]*", ""), r"#[A-Za-z0-9_-]{20,}", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[\n\r\t]+", " "), " +", " "))
    plain = _compatible(distinct_sentences(plain))
    plain = F.replace(F.translate(plain, "“”‘’ ", "\"\"'' "), F.lit("—"), F.lit(" - "))
    return F.regexp_replace(plain, r"^\s+|\s+\z", "")


def truncated(text: Column, limit: Column | int) -> Column:
    """At most `limit` characters, cut at a space where there is one, with an ellipsis; limits below 1 don't cut."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    head = F.regexp_replace(F.substr(text, F.lit(1), n), " [^ ]*\\z", "")
    return F.when((n <= 0) | (F.length(text) <= n), text).otherwise(F.concat(F.regexp_replace(head, "\\s+\\z", ""), F.lit("…")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def publisher_slug(name: Column) -> Column:
    slug = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))


# Words that name an edition, not a publisher.
EDITION_WORDS = "world news international global online english edition uk us usa digital live latest headlines".split()


def publisher_identity(name: Column) -> Column:
    """What names the publisher: no leading article, no edition words (unless nothing else is there)."""
    lowered = F.regexp_replace(F.trim(F.lower(F.coalesce(name, F.lit("")))), "^(?:the|an|a) ", "")
    words = F.filter(F.split(F.regexp_replace(lowered, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(EDITION_WORDS))
    joined = F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), "-")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("unknown"))


def json_list(text: Column) -> Column:
    """A JSON list of strings; an empty one where the text is null or malformed."""
    return F.coalesce(F.from_json(text, T.ArrayType(T.StringType())), F.array().cast("array<string>"))


def without_fences(text: Column) -> Column:
    bare = F.regexp_replace(text, r"^\s+|\s+\z", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^```(?:json)?\s*", ""), r"\s*```\z", ""), r"^\s+|\s+\z", "")


def cursor(stamp: Column, ident: Column) -> Column:
    """URL-safe key of a place in a feed: base64 of the ISO stamp (micros only if there are any), a pipe and the id."""
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(stamp, "SSSSSS")
    text = F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("|"), ident.cast("string"))
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), F.lit("="))


def decoded_cursor(key: Column) -> Column:
    """struct(stamp, id) of a cursor; null fields where it is malformed."""
    text = F.decode(F.unbase64(F.translate(key, "-_", "+/")), "UTF-8")
    stamp = F.regexp_extract(text, r"^(.*)\|", 1)
    return F.struct(stamp.try_cast("timestamp_ntz").alias("stamp"), F.regexp_extract(text, r"\|([^|]*)$", 1).try_cast("long").alias("id"))


# Characters of a title that are stored, characters of a text that stand for a token.
TITLE_CHARS, TOKEN_CHARS = 1024, 4


def stored_title(title: Column) -> Column:
    """A title as it is stored: trimmed, at most TITLE_CHARS characters."""
    return F.left(F.trim(title), F.lit(TITLE_CHARS))


def token_slice(text: Column, tokens: int) -> Column:
    """The beginning of a text that `tokens` tokens stand for, by characters; empty for null."""
    return F.left(F.coalesce(text, F.lit("")), F.lit(tokens * TOKEN_CHARS))


def client_key(forwarded: Column, peer: Column) -> Column:
    """Whom a request is from: the first address of the forwarded header, else the peer, else `unknown`."""
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(first, F.lit("")), peer, F.lit("unknown"))
