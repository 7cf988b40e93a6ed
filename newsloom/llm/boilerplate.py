"""Keep only the main body of web pages and of texts taken from them (problem 5).

Host suffix array. The pages of a host become one stream of tokens, block by block, with marks between blocks and
pages and the site's name masked; a number that is no year matches nothing. A suffix array over the stream finds the runs of tokens that stand on at
least MIN_PAGES pages; pages that have much of their text in common with an earlier one (the same story delivered again) are no evidence.
A block that such runs cover, from its opening mark to its closing one, is boilerplate; unique runs stay. Hosts of more
than SHARD_BYTES are cut into shards of about that size, each with an array of its own; whole blocks that stand on
MIN_PAGES pages of all shards together, copies again left out, go as well. Blocks of hosts too small to show a repeat are looked up among the blocks of all hosts: one
that stands, masked, on COMMON_PAGES pages of COMMON_HOSTS hosts with ever other text behind it is boilerplate too.

Of a page, the unique run that belongs to the headline (the page's title) is the story: the blocks beside it in its
element, or in the element right behind it. Of a text, the unique lines are. Headings, bylines and captions are unique
too; they are told from prose by how they end (`reading`): prose ends like a sentence, or is a long block of a script that
has no such marks, or a long block that leads on (a colon, say) to prose behind it; the items of a list that such a block leads to
are prose as well.

Null and empty pages have no blocks; a page may have none. Broken markup is read as far as it goes. Pages are read
whole. Repeated rows give repeated blocks. Rows without a host share one.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.nearduplicates import WIDTH, _mix, window_hashes
from newsloom.session import cut, written

MARKS = 4
LONG_RUN = 32
LONG_BLOCK = 130
MIN_PAGES = 3
SHARD_BYTES = 4 << 20
COMMON_PAGES = 8
COMMON_HOSTS = 4
INLINE = frozenset("a abbr b big cite code em font i label mark q s small span strike strong sub sup time u wbr img".split())
SILENT = frozenset("script style noscript template svg iframe head title".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.I | re.S)
_END = re.compile("[.!?。！？।؟۔…][\"'”’“»›」』)\\]）】\\s]*$")
_LEADS = re.compile("[:;,：；，、،؛][\"'”’“»›」』)\\]）】\\s]*$")
_ITEM = re.compile(r"\s*(?:[-•·*–—‣▪]|\(?\d{1,3}[.)])\s+\S")
_UNMARKED = re.compile("[\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff]")  # Thai, Lao, Tibetan, Myanmar, Khmer
UNMARKED_LEAST = 40  # characters of a block of prose in these scripts
LEADING_WORDS = 8  # of a block that leads on
_WORD = re.compile(r"\w+|[^\w\s]")
_NUMBER = re.compile(r"\d+")
_DIGIT = re.compile(r"\d")
_YEAR = re.compile(r"(?:19|20)\d\d$")


@dataclass
class Block:
    text: str
    element: int
    container: int = -1


@dataclass
class Page:
    title: str = ""
    blocks: list[Block] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)  # of each element
    names: list[str] = field(default_factory=list)  # of each element
    headline: int = -1  # the headline's block


def squeeze(text: str) -> str:
    return " ".join(text.split())


def read_page(source: str) -> Page:
    """Visible text blocks of a page with the elements they stand in."""
    page = Page()
    m = _TITLE.search(source)
    page.title = squeeze(html.unescape(m[1])) if m else ""
    stack: list[tuple[str, int]] = [("", 0)]
    page.parent.append(-1)
    page.names.append("")
    buffer: list[str] = []
    silent: str | None = None
    hidden: int | None = None  # depth of the stack at which hidden text began

    def flush() -> None:
        if buffer:
            text = squeeze(html.unescape("".join(buffer)))
            buffer.clear()
            if text:
                page.blocks.append(Block(text, stack[-1][1]))

    def close(depth: int) -> None:
        nonlocal hidden
        del stack[depth:]
        if hidden is not None and len(stack) <= hidden:
            hidden = None

    for m in _TOKEN.finditer(source):
        name = m[2]
        if name is None:
            if silent is None and hidden is None and not m[0].startswith("<!--"):
                buffer.append(m[0])
            continue
        name = name.lower()
        if silent is not None:
            if m[1] and name == silent:
                silent = None
            continue
        if name in SILENT:
            if not m[1] and not m[3].endswith("/"):
                silent = name
            continue
        if name in INLINE:
            continue
        flush()
        if name in ("br", "hr", "meta", "link", "input"):
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if stack[-1][0] == "p":
            close(len(stack) - 1)
        if name in ("li", "tr", "td", "th", "dt", "dd"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name or name == "tr" and stack[k][0] in ("td", "th"):
                    close(k)
                elif stack[k][0] in ("ul", "ol", "table", "dl") or name in ("td", "th") and stack[k][0] == "tr":
                    break
        stack.append((name, len(page.parent)))
        page.parent.append(stack[-2][1])
        page.names.append(name)
        if hidden is None and _HIDDEN.search(m[3]):
            hidden = len(stack) - 1
    flush()

    of: dict[int, int] = {}
    for b in page.blocks:
        of[b.element] = of.get(b.element, 0) + 1
    holders = {page.parent[e] for e in of}
    for b in page.blocks:
        several = of[b.element] > 1 or b.element in holders
        b.container = b.element if several or page.parent[b.element] < 0 else page.parent[b.element]
    bare = page.title.rsplit(" | ", 1)[0]
    for wanted in (bare, page.title):
        for k, b in enumerate(page.blocks):
            if wanted and b.text == wanted:
                page.headline = k
                return page
    return page


def reading(texts: list[str], follows: list[int]) -> list[bool]:
    """Which blocks read like prose. follows[k]: the block behind block k in its element, or the first item of the list
    there, else -1."""
    out = [bool(_END.search(t)) or len(t) >= UNMARKED_LEAST and 2 * len(_UNMARKED.findall(t)) > len(t) for t in texts]
    for k in range(len(texts) - 1, -1, -1):
        if not out[k] and follows[k] >= 0 and _LEADS.search(texts[k]) and len(texts[k].split()) >= LEADING_WORDS:
            out[k] = out[follows[k]] or bool(_ITEM.match(texts[follows[k]])) or len(texts[k].rstrip()) > 0 and texts[k].rstrip()[-1] in ":："
    return out


FIRST = 1 << 40  # weight of a set that is taken before any other


def list_items(page: Page, k: int) -> list[int]:
    """The items of the list right behind block k of a page, in the element that k stands in."""
    out = []
    for j in range(k + 1, len(page.blocks)):
        holder = page.parent[page.blocks[j].element]
        if page.names[page.blocks[j].element] != "li" or holder < 0 or page.parent[holder] != page.blocks[k].container:
            break
        out.append(j)
    return out


def story_sets(page: Page, plain: list[bool]) -> dict[int, tuple[int, int]]:
    """{block: (set, weight)} of the runs that may belong to the headline; the set of most weight is the story, the
    least of equal ones. plain[k]: block k is no boilerplate and reads like prose."""
    if page.headline < 0:
        # no headline: the element with most of the page's own sentences
        out = {k: (b.container, len(b.text)) for k, b in enumerate(page.blocks) if plain[k]}
    else:
        head = page.blocks[page.headline]
        out = {k: (0, FIRST) for k in range(page.headline + 1, len(page.blocks)) if plain[k] and page.blocks[k].container == head.container}
        behind = [e for e in range(head.element + 1, len(page.parent)) if page.parent[e] == page.parent[head.element]]
        for k in range(page.headline + 1, len(page.blocks)):
            if plain[k] and behind and page.blocks[k].container == behind[0]:
                out.setdefault(k, (1, 1))
    return out


def masked(text: str, site: str) -> str:
    if site:
        text = text.replace(site, " § ")
    return text.lower()


def _variable(word: str) -> bool:
    """A number that isn't a year: it says something, so a block with one is no standing text."""
    return word[0].isdigit() and not _YEAR.match(word)


class _Ids(dict):
    """Numbers of words, from 2; -1 for numbers that say something."""

    def __missing__(self, word: str) -> int:
        self[word] = n = -1 if _variable(word) else len(self) + 2
        return n


def repeats(tokens: np.ndarray, page: np.ndarray, evidence: np.ndarray, least: int = MIN_PAGES, longest: int = 64) -> np.ndarray:
    """For every place of the stream, the length of the longest run from there that `least` pages have (up to `longest`).

    A suffix array by prefix doubling; runs shared by neighbouring suffixes come from the ranks of each doubling. Only
    suffixes of pages that are `evidence` count, one for each page.
    """
    if least != 3:
        raise ValueError("runs are sought for three pages")
    n = len(tokens)
    levels = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    k = 1
    while k < longest:
        r = levels[-1]
        second = np.full(n, -1, np.int64)
        second[:-k] = r[k:] if k < n else second[:-k]
        levels.append(np.unique(r * (n + 1) + second + 1, return_inverse=True)[1].astype(np.int64))
        k *= 2
    order = np.argsort(levels[-1], kind="stable")
    order = order[evidence[order]]
    if len(order) < least:
        return np.zeros(n, np.int64)

    def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for j in range(len(levels) - 1, -1, -1):
            x, y = a + out, b + out
            inside = (x < n) & (y < n)
            same = inside & (levels[j][np.minimum(x, n - 1)] == levels[j][np.minimum(y, n - 1)])
            out += np.where(same, 1 << j, 0)
        return out

    best = np.zeros(n, np.int64)
    first, second = _others(page[order])
    last = len(order) - 1
    up, upper = (np.where(x >= 0, last - x, -1) for x in (y[::-1] for y in _others(page[order][::-1])))

    def run(at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, shared(order[np.maximum(at, 0)], order), 0)

    # the nearest suffixes of two other pages: both before, both behind, or one on each side
    between = (first >= 0) & (up >= 0) & (page[order[first]] != page[order[up]])
    sides = np.where(between, np.minimum(run(first), run(up)), 0)
    best[order] = np.maximum(sides, np.maximum(run(second), run(upper)))
    return best


def _others(pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of an array of pages, the last place before it of another page, and the last of a third; else -1."""
    n = len(pages)
    starts = np.flatnonzero(np.concatenate([[True], pages[1:] != pages[:-1]]))
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    ends = np.append(starts[1:], n) - 1
    kind = pages[starts]
    at = np.full(len(starts), -1, np.int64)
    at[2:] = np.where(kind[2:] != kind[:-2], np.arange(len(starts) - 2), -1)  # else what the run before it has
    at = np.maximum.accumulate(at)
    first = np.where(run > 0, ends[run - 1], -1)
    third = at[run]
    return first, np.where(third >= 0, ends[third], -1)


def _copies(pages: list[list[tuple[int, int]]]) -> list[bool]:
    """Pages of whose long blocks one earlier page has a quarter. pages: [(block hash, its length if long, else 0)]."""
    first: dict[int, int] = {}
    out = []
    for k, blocks in enumerate(pages):
        common: dict[int, int] = {}
        total = 0
        for h, n in blocks:
            total += n
            if n and h in first:
                common[first[h]] = common.get(first[h], 0) + n
        out.append(bool(common) and max(common.values()) * 4 >= total)
        for h, _ in blocks:
            first.setdefault(h, k)
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _marks(texts: list[str]) -> list[list[int]]:
    """MARKS minima of the hashes of each text's windows, most of which a small change leaves; none of short texts."""
    out: list[list[int]] = [[] for _ in texts]
    joined = "".join(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    good = np.flatnonzero(lengths >= WIDTH)
    if len(good):
        h = window_hashes(joined)
        bounds = np.stack([starts[good], starts[good] + lengths[good] - WIDTH + 1], 1).ravel()
        minima = []
        for turn in range(MARKS):
            g = np.append(_mix(h + np.uint64(turn)), np.uint64(2**64 - 1))
            minima.append(np.minimum.reduceat(g, bounds)[::2].view(np.int64))
        for k, m in zip(good, np.stack(minima, 1).tolist()):
            out[k] = m
    return out


def host_blocks(pdf: pd.DataFrame, sharded: bool = False) -> pd.DataFrame:
    """All sentence-like blocks of one host's (or shard's) pages.

    (id, field, md5, choice, weight, hash, fixed, chars, behind): choice and weight as in story_sets, null for no story;
    hash of the masked block; fixed: without a number that is no year; marks: see `_marks`, of shards only; behind:
    hash of the next block."""
    parsed: list[tuple[int, str, Page | None, list[str], list[str]]] = []
    for key, kind, site, content in zip(pdf["id"], pdf["field"], pdf["site"], pdf["content"]):
        page = read_page(content) if kind == "raw_html" else None
        texts = [b.text for b in page.blocks] if page else [t for t in map(squeeze, content.split("\n")) if t]
        parsed.append((key, kind, page, texts, [masked(t, site if isinstance(site, str) else "") for t in texts]))

    ids = _Ids()
    number = ids.__getitem__
    stream: list[int] = []
    pages: list[int] = []  # tokens of each page
    spans: list[list[tuple[int, int]]] = []
    sizes = []
    for _, _, _, _, masks in parsed:
        own, size, start = [], [], len(stream)
        for m in masks:
            begin = len(stream)
            stream.append(0)
            stream.extend(map(number, _WORD.findall(m)))
            stream.append(1)
            own.append((begin, len(stream)))
            wide = 3 if any("\u3040" <= c <= "\u9fff" for c in m[:20]) else 1
            size.append((_hash(m), len(m) * wide if len(m) * wide >= LONG_BLOCK else 0))
        stream.append(-1)  # no run goes on beyond a page
        pages.append(len(stream) - start)
        spans.append(own)
        sizes.append(size)
    tokens, page_of = np.array(stream, np.int64), np.repeat(np.arange(len(pages)), pages)
    single = np.flatnonzero(tokens == -1)
    tokens[single] = -1 - np.arange(len(single))  # each matches nothing
    evidence = ~np.array(_copies(sizes), bool)[page_of] if len(stream) else np.zeros(0, bool)
    run = repeats(tokens, page_of, evidence) if len(stream) else np.zeros(0, np.int64)
    # places covered by long runs
    edge = np.zeros(len(stream) + 65, np.int64)
    long = np.flatnonzero(run >= LONG_RUN)
    np.add.at(edge, long, 1)
    np.add.at(edge, long + run[long], -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[: len(stream)] > 0)])

    marks = iter(_marks([m for *_, masks in parsed for m in masks]) if sharded else [])
    rows = []
    for (key, kind, page, texts, _), own, size in zip(parsed, spans, sizes):
        # one run from the opening to the closing mark, or, in blocks longer than any run, long ones without a gap
        dull = [run[a] >= b - a or (run[a] >= LONG_RUN and covered[b] - covered[a] == b - a and run[b - LONG_RUN] >= LONG_RUN) for a, b in own]
        items = {k: list_items(page, k) for k, t in enumerate(texts) if _LEADS.search(t)} if page else {}
        if page:
            follows = [k + 1 if k + 1 < len(texts) and page.blocks[k + 1].container == page.blocks[k].container else items[k][0] if items.get(k) else -1 for k in range(len(texts))]
        else:
            follows = [*range(1, len(texts)), -1][: len(texts)]
        prose = reading(texts, follows)
        plain = [e and not d for e, d in zip(prose, dull)]
        story = story_sets(page, plain) if page else {j: (0, 1) for j, p in enumerate(plain) if p}
        for k in range(len(texts)):
            if k in story and _LEADS.search(texts[k]):  # what it leads to belongs to it
                led = items.get(k, []) if page else [j for j in range(k + 1, len(texts)) if all(_ITEM.match(t) for t in texts[k + 1 : j + 1])]
                for j in led:
                    if not dull[j]:
                        prose[j] = True
                        story.setdefault(j, story[k])
        for j, t in enumerate(texts):
            mark = next(marks, None)
            if prose[j]:
                behind = size[j + 1][0] if j + 1 < len(size) else 0
                fixed = not _DIGIT.search(t) or not any(_variable(w) for w in _NUMBER.findall(t))
                rows.append((key, kind, hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest(), *story.get(j, (None, None)), size[j][0], fixed, mark, behind))
    out = pd.DataFrame(rows, columns=["id", "field", "md5", "choice", "weight", "hash", "fixed", "marks", "behind"])
    return out.astype({"choice": "Int64", "weight": "Int64"})


def host_wide(blocks: DataFrame) -> DataFrame:
    """(host, hash) of the blocks that stand on MIN_PAGES pages of a host, whatever shards these are in.

    Copies, even edited ones, are no evidence: of the pages with a block, those that have a quarter of the marks of
    their other possible story in common with one earlier of them, and those that have no other."""
    each = blocks.select("host", F.struct("id", "field").alias("page"), "hash", "fixed", F.col("choice").isNotNull().alias("plain"), "marks")
    often = each.where("fixed").groupBy("host", "hash").agg(F.countDistinct("page").alias("pages"), F.max("plain").alias("plain")).where((F.col("pages") >= MIN_PAGES) & F.col("plain"))
    holders = each.where("fixed").join(often.select("host", "hash"), ["host", "hash"], "left_semi").select("host", "hash", "page").distinct()
    others = holders.join(each.where("plain").select("host", "page", F.col("hash").alias("other"), "marks"), ["host", "page"]).where("other <> hash")
    others = others.select("host", "hash", "page", F.explode("marks").alias("mark")).distinct()
    first = others.groupBy("host", "hash", "mark").agg(F.min("page").alias("first"))
    shared = others.join(first, ["host", "hash", "mark"]).groupBy("host", "hash", "page", "first").agg(F.count("*").alias("common"))
    most = F.max(F.when(F.col("first") < F.col("page"), F.col("common")).otherwise(0))
    own = shared.groupBy("host", "hash", "page").agg(most.alias("most"), F.sum("common").alias("rest")).where("most * 4 < rest")
    return own.groupBy("host", "hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES).select("host", "hash")


def body_blocks(pages: DataFrame) -> DataFrame:
    """(id, field, block_md5) of every main-body block of `pages` (id, field, host, site, content).

    field `raw_html` is read as markup, any other as lines of text."""
    rows = pages.where("content is not null and content <> ''").select("id", "field", F.coalesce("host", F.lit("")).alias("host"), "site", "content")
    bytes_ = F.sum(F.octet_length("content").cast("long"))
    shards = cut(pages.where("content is not null").groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.greatest(F.lit(1), F.ceil(bytes_ / SHARD_BYTES)).cast("long").alias("shards")))
    groups = shards.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    rows = rows.join(shards, "host").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))
    kind = "id long, field string, md5 string, choice long, weight long, hash long, fixed boolean, marks array<long>, behind long"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sharded = bool(pdf["shards"].iloc[0] > 1)
        return host_blocks(pdf, sharded).assign(host=key[0], sharded=sharded)

    blocks = written(rows.select("host", "shard", "shards", "id", "field", "site", "content").repartition(max(8, 2 * groups), "host", "shard").groupBy("host", "shard").applyInPandas(run, kind + ", host string, sharded boolean"), "blocks")
    common = blocks.where("fixed").groupBy("hash").agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"), F.approx_count_distinct("behind").alias("behinds"))
    common = common.where((F.col("n") >= COMMON_PAGES) & (F.col("hosts") >= COMMON_HOSTS) & (F.col("behinds") * 2 >= F.least("n", F.lit(40))))
    story = blocks.where("choice is not null").join(common.select("hash"), "hash", "left_anti")
    story = story.join(host_wide(blocks.where("sharded")), ["host", "hash"], "left_anti").select("id", "field", "md5", "choice", "weight")
    # of a page, the set that weighs most without what the other pages took away
    weighed = story.where("field = 'raw_html'").groupBy("id", "field", "choice").agg(F.sum("weight").alias("weight"))
    best = weighed.groupBy("id", "field").agg(F.min_by("choice", F.struct(-F.col("weight"), F.col("choice"))).alias("choice"))
    chosen = story.where("field = 'raw_html'").join(best, ["id", "field", "choice"], "left_semi").unionByName(story.where("field <> 'raw_html'"), allowMissingColumns=True)
    return chosen.select("id", "field", F.col("md5").alias("block_md5")).distinct()
