"""HTML extraction: structure as a hint, then repeated substrings of a host.

Each page is parsed into blocks. Elements that HTML itself defines as something else than main text (menus,
footers, asides, forms, scripts and the like) go, and so do elements whose class or id holds, as a whole
name, one of a short list (``ad``, ``comments``). Where the page marks an ``article`` or ``main``, its blocks are
the main text: of several articles, nested ones included, the one with the most text, as the others are
comments or teasers. Other pages offer all their loose blocks.

Boilerplate is then removed by repetition. The token streams of a host's pages are concatenated and their suffixes
named by prefix doubling: the name of 2 h tokens is made of the names of the first and the last h. Suffixes of distinct pages that share the
name of their first ``RUN`` tokens are neighbours in the host's suffix array with a common prefix of at least that length, and
the union of such prefixes is the union of all repeated substrings, so no array has to be sorted. On pages with loose blocks the
tokens that repeated substrings cover go, and the runs in between stay. In a marked article a block goes only if all of it
repeats on at least ``MOST`` pages and on half of the host's pages, as articles quote and share passages.

Pages with the same stream count as one, so mirrored articles are whole texts. A page of loose blocks that is covered by more than half
may be a near mirror: only runs that ``MOST`` pages share are boilerplate there, and if these cover all of it, it stays as it is.

Names meet through a shuffle that is pre-aggregated, and places meet the table of repeated names in a join that
can be split, so a host with a third of all pages is no single task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hit_bits, in_arrow, settle, with_hits, without_hits

#: Fewest tokens of a substring that counts as repeated; a power of two.
RUN = 8
#: Distinct pages that make a repeated block of an article boilerplate.
MOST = 3

_SILENT = {"script", "style", "head", "title", "noscript", "template", "iframe", "object", "svg", "canvas", "math", "audio", "video"}
_CHROME = {"nav", "footer", "aside", "form", "button", "select", "textarea", "menu", "dialog", "fieldset", "label", "input", "option"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu",
    "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements whose start and end are followed; others only break blocks or do nothing.
_NESTED = {"article", "main"} | _SILENT | _CHROME | {"header", "div", "section", "ul", "ol", "dl", "table", "span", "figure", "blockquote", "details", "body", "html"}
_VOID = {"input", "br", "hr", "img", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Whole names in class and id that say that an element is no main text.
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsored", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer",
    "cookie-notice", "cookie-banner", "cookies", "notice", "newsletter", "subscribe", "social", "share", "related", "comments", "comment", "replies",
}


class _Page(HTMLParser):
    """Blocks of one page, each with the unit it belongs to: an article's number, 0 in main alone, -1 elsewhere."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")

    def __init__(self, structure: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.structure = structure
        self.stack: list[tuple[str, int, bool]] = []  # tag, adds to skipped, opens a unit
        self.skipped = self.articles = 0
        self.units = [-1]
        self.marked = False
        self.parts: list[str] = []
        self.blocks: list[tuple[int, str]] = []

    def _break(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.blocks.append((self.units[-1], text))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self._break()
        elif tag in ("br", "img"):
            self.handle_data(" ")
        if tag in _VOID or tag not in _NESTED:
            return
        skip, unit = 0, None
        if not self.structure:
            skip = int(tag in _SILENT)
        elif tag in _SILENT or tag in _CHROME or tag == "header" and len(self.units) == 1:
            skip = 1
        elif tag in ("article", "main"):
            # an article is no part of a menu or header that was left open
            while self.stack and self.skipped and self.stack[-1][0] not in _SILENT and len(self.units) == 1 and self.stack[-1][0] != "aside":
                self._pop()
            if not self.skipped and tag == "article":
                self.articles += 1
                unit = self.articles
            elif not self.skipped:
                unit = max(self.units[-1], 0)
        if self.structure and not skip and tag not in ("body", "html"):
            for name, value in attrs:
                if value and (name in ("class", "id") and not _NAMES.isdisjoint(value.lower().split()) or name == "role" and value.lower() in _ROLES):
                    skip, unit = 1, None
        if unit is not None:
            self.marked = True
            self.units.append(unit)
        self.stack.append((tag, skip, unit is not None))
        self.skipped += skip

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing on elements that can hold text

    def _pop(self) -> str:
        tag, skip, opened = self.stack.pop()
        self.skipped -= skip
        if opened:
            self.units.pop()
        return tag

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._break()
        if tag in _NESTED and any(t == tag for t, _, _ in self.stack):
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)


def blocks_of(html: str | None, structure: bool = True) -> tuple[bool, list[str]]:
    """Whether the page marks its article, and the blocks of the article or the loose ones.

    Without ``structure`` all visible blocks are loose ones.
    """
    page = _Page(structure)
    page.feed(html or "")
    page.close()
    page._break()
    if not page.marked:
        return False, [text for _, text in page.blocks]
    sizes: dict[int, int] = {}
    for unit, text in page.blocks:
        sizes[unit] = sizes.get(unit, 0) + len(text)
    chosen = min((u for u in sizes if u > 0), key=lambda u: (-sizes[u], u), default=0)
    return True, [text for unit, text in page.blocks if unit in (0, chosen)]


def _doubled(names: np.ndarray, h: int) -> np.ndarray:
    """Names of 2 h tokens from those of h tokens."""
    a, b = names[: max(len(names) - h, 0)], names[h:]
    x = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1B54A32D192ED03) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def suffix_names(tokens: list[str], run: int = RUN) -> np.ndarray:
    """64-bit names of the first ``run`` tokens of each suffix that has as many, by prefix doubling."""
    names = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) for t in tokens), np.uint64, len(tokens))
    h = 1
    while h < run:
        names, h = _doubled(names, h), 2 * h
    return names.view(np.int64)


def block_names(blocks: list[str]) -> np.ndarray:
    """64-bit names of whole blocks."""
    return np.fromiter((xxhash.xxh64_intdigest(b.encode("utf-8", "replace"), RUN) for b in blocks), np.uint64, len(blocks)).view(np.int64)


def _covered(n: int, places: set[int], run: int) -> list[bool]:
    covered, end = [False] * n, 0
    for i in range(n):
        if i in places:
            end = i + run
        covered[i] = i < end
    return covered


def unique_runs(blocks: list[str], repeated: dict[int, int], run: int = RUN) -> list[str]:
    """The blocks without the tokens that repeated suffixes (place to number of pages) cover; emptied blocks go."""
    words = [b.split() for b in blocks]
    n = sum(map(len, words))
    covered = _covered(n, set(repeated), run)
    if 2 * sum(covered) > n:
        covered = _covered(n, {i for i, pages in repeated.items() if pages >= MOST}, run)
        if all(covered):
            return blocks
    kept, at = [], 0
    for w in words:
        kept.append(" ".join(x for j, x in enumerate(w) if not covered[at + j]))
        at += len(w)
    return [k for k in kept if k]


def extract(pages: DataFrame, run: int = RUN, structure: bool = True) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``.

    Null html counts as empty; a page without main text has an empty text. A null url is a host of
    its own. Rows with equal streams are one page for the repetition test and are all
    returned, whatever their page_id, which may be null. An empty table gives an empty result; other columns are ignored. Without
    ``structure`` every visible block is offered and repetition alone decides.
    """
    parsed = settle(_parsed(pages, run, structure), "pages", compression="zstd")
    named = repeated_names(parsed)
    text = F.array_join("blocks", "\n").alias("text")
    found = named.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias("repeated"))
    found = settle(found, "repeated-places", compression="zstd")
    hit = hit_bits(found, "row")
    result = without_hits(parsed, "row", hit).select("page_id", "url", text)
    result = result.unionByName(_cleaned(with_hits(parsed, "row", hit).join(found, "row", "left"), run))
    return result.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def repeated_names(parsed: DataFrame) -> DataFrame:
    """row, pos, n: the places of ``parsed`` pages whose name n distinct pages of the host share, where that makes them boilerplate."""
    places = parsed.select("row", "host", "marked", "stream", F.posexplode("names").alias("pos", "name"))
    counted = places.groupBy("host", "marked", "name", "stream").agg(F.lit(1)).groupBy("host", "marked", "name").agg(F.count("*").alias("n")).where("n > 1")
    hosts = parsed.groupBy("host", "stream").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("streams"))
    counted = counted.join(hosts, "host").where(f"NOT marked OR n >= {MOST} AND 2 * n >= streams").drop("streams")
    counted = settle(counted, "repeated-names")  # as a table, so that AQE can split a hot name's join
    return places.join(counted, ["host", "marked", "name"]).select("row", "pos", "n")


def _parsed(pages: DataFrame, run: int, structure: bool) -> DataFrame:
    """row, page_id, url, host, marked, stream (hash), blocks, names: of blocks where an article is marked, else of suffixes."""
    names = ["row", "page_id", "url", "host", "marked", "stream", "blocks", "names"]

    def parse(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [blocks_of(h, structure) for h in batch.column("html").to_pylist()]
        streams = [" ".join(blocks) for _, blocks in found]
        keys = [block_names(blocks) if marked else suffix_names(s.split(), run) for (marked, blocks), s in zip(found, streams)]
        made = [pa.array([m for m, _ in found]), pa.array([xxhash.xxh64_intdigest(s.encode("utf-8", "replace")) >> 1 for s in streams], pa.int64())]
        made += [pa.array([b for _, b in found], pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:4]] + made, names)

    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit("")).alias("host"), F.col("html").cast("string").alias("html"),
    )
    return in_arrow(rows, parse, "row bigint, page_id bigint, url string, host string, marked boolean, stream bigint, blocks array<string>, names array<bigint>")


def _cleaned(pages: DataFrame, run: int) -> DataFrame:
    def clean(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for marked, blocks, repeated in zip(*(batch.column(c).to_pylist() for c in ("marked", "blocks", "repeated"))):
            places = dict(repeated or ())
            texts.append("\n".join([b for i, b in enumerate(blocks) if i not in places] if marked else unique_runs(blocks, places, run)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return in_arrow(pages.select("page_id", "url", "marked", "blocks", "repeated"), clean, "page_id bigint, url string, text string")
