"""Feed documents as rows: RSS and Atom markup, an aggregator's JSON, seed files, and page bodies."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = "feed string, entry_no int, title string, url string, summary string, published string"
AGGREGATOR = T.StructType(
    [
        T.StructField(
            "articles",
            T.ArrayType(
                T.StructType(
                    [
                        *[T.StructField(c, T.StringType()) for c in ("title", "url", "description", "publishedAt")],
                        T.StructField("source", T.StructType([T.StructField("name", T.StringType()), T.StructField("url", T.StringType())])),
                    ]
                )
            ),
        )
    ]
)


def _local(tag: object) -> str:
    return str(tag).rsplit("}", 1)[-1].lower()


def entries(document: str | None) -> list[tuple[str, str, str | None, str | None]]:
    """(title, link, summary, published) of a feed document's items with a title and a link; none if it can't be read."""
    try:
        root = ET.fromstring((document or "").strip())
    except (ET.ParseError, ValueError):
        return []
    out = []
    for item in root.iter():
        if _local(item.tag) not in ("item", "entry"):
            continue
        got: dict[str, str] = {}
        for child in item:
            name = _local(child.tag)
            text = "".join(child.itertext()).strip()
            if name == "link":
                text = text or child.get("href", "").strip()
            name = {"description": "summary", "content": "summary", "pubdate": "published", "updated": "published", "date": "published"}.get(name, name)
            if text:
                got.setdefault(name, text)
        if got.get("title") and got.get("link"):
            out.append((got["title"], got["link"], got.get("summary"), got.get("published")))
    return out


def parse_feeds(documents: DataFrame, name: str, text: str) -> DataFrame:
    """(feed, entry_no, title, url, summary, published) of all readable feed documents; the others give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(n, k, *e) for n, t in zip(batch["n"], batch["t"]) for k, e in enumerate(entries(t))]
            yield pd.DataFrame(rows, columns=["feed", "entry_no", "title", "url", "summary", "published"]).astype({"entry_no": "int32"})

    return documents.select(F.col(f"`{name}`").cast("string").alias("n"), F.col(f"`{text}`").alias("t")).mapInPandas(run, ENTRY)


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    documents = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value")
    return parse_feeds(documents, "name", "value")


def flatten_aggregator(documents: DataFrame, text: str) -> DataFrame:
    """(title, url, description, published, publisher) of an aggregator's responses; rows without title, url or publisher drop."""
    items = documents.select(F.explode(F.from_json(F.col(f"`{text}`"), AGGREGATOR)["articles"]).alias("a"))
    flat = items.select(F.trim("a.title").alias("title"), F.trim("a.url").alias("url"), F.col("a.description").alias("description"), F.col("a.publishedAt").alias("published"), F.trim("a.source.name").alias("publisher"))
    return flat.where("title <> '' AND url <> '' AND publisher <> ''")


_STAMP = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"


def published_utc(stamp: Column) -> Column:
    """An RFC 3339 stamp as a timestamp without zone, in UTC; one without an offset is taken as it stands, a bad one is null."""
    text = F.when(stamp.rlike(_STAMP), stamp)
    micros = F.unix_micros(text.try_cast("timestamp")).cast("decimal(20,0)") / 1000000
    moved = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros.cast("decimal(18,6)"))
    return F.when(text.rlike("(?:Z|\\d[+-]\\d{2}:\\d{2})$"), moved).otherwise(text.try_cast("timestamp_ntz"))


def read_by_kind(documents: DataFrame, readers: dict[str, Callable[[DataFrame], DataFrame]], default: str = "rss") -> DataFrame:
    """Entries of documents (kind, ...) of several kinds: each kind goes through its own reader, documents of null or
    unknown kind through that of `default`. All readers give the same columns."""
    kind = F.when(F.col("kind").isin(list(readers)), F.col("kind")).otherwise(default)
    parts = [reader(documents.where(kind == name)) for name, reader in readers.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class _Paragraphs(HTMLParser):
    """Text of <p> elements outside scripts, styles and page furniture."""

    OUT = frozenset("script style nav header footer".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.outside, self.inside, self.found = 0, False, []

    def handle_starttag(self, tag, attrs):
        if tag in self.OUT:
            self.outside += 1
        elif tag == "p" and not self.outside:
            self.inside = True
            self.found.append("")

    def handle_endtag(self, tag):
        if tag in self.OUT:
            self.outside = max(0, self.outside - 1)
        elif tag == "p":
            self.inside = False

    def handle_data(self, data):
        if self.inside and not self.outside:
            self.found[-1] += data


class _Article(_Paragraphs):
    """Text of <p> elements inside <article> or <main>."""

    def __init__(self) -> None:
        super().__init__()
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("article", "main")
        if self.depth:
            super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        if tag in ("article", "main"):
            self.depth, self.inside = max(0, self.depth - 1), False


def paragraphs(page: str, parser: type[_Paragraphs] = _Paragraphs) -> str:
    p = parser()
    p.feed(page)
    p.close()
    return "\n".join(t for t in (" ".join(x.split()) for x in p.found) if t)


def article_paragraphs(page: str) -> str:
    return paragraphs(page, _Article)


# Words that a layer must give, characters of a body that are kept.
LEAST_WORDS, MOST_CHARS = 50, 50_000
LAYERS: tuple[Callable[[str], str], ...] = (article_paragraphs, paragraphs)


def body_text(page: str | None, least_words: int = LEAST_WORDS, layers: tuple[Callable[[str], str], ...] = LAYERS, most_chars: int | None = None) -> str | None:
    """What the first layer that finds at least `least_words` words finds, up to `most_chars`; null where none does."""
    for layer in layers if page else ():
        text = layer(page)
        if text and len(text.split()) >= least_words:
            return text if most_chars is None else text[:most_chars]
    return None


def page_bodies(pages: DataFrame, key: str, markup: str, least_words: int = LEAST_WORDS, layers: tuple[Callable[[str], str], ...] = LAYERS, most_chars: int | None = None) -> DataFrame:
    """(key, body) of every page; body is null where no layer finds enough text. most_chars: MOST_CHARS is the usual bound."""

    @F.pandas_udf(T.StringType())
    def body(markups: pd.Series) -> pd.Series:
        return markups.map(lambda m: body_text(m, least_words, layers, most_chars), na_action="ignore")

    return pages.select(F.col(f"`{key}`").alias(key), body(F.col(f"`{markup}`")).alias("body"))


def read_seed(spark: SparkSession, path: str, root: str, schema: str) -> DataFrame:
    """Rows of a YAML seed file's list under `root`."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = (yaml.safe_load(f) or {}).get(root) or []
    names = T._parse_datatype_string(schema).names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
