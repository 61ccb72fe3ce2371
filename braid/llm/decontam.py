"""Benchmark decontamination by pigeonhole edit matching, on words.

An item of m words has an error budget of k = m // 5 word edits (a similarity of 0.8). Cut
into k + 1 pieces, any occurrence within the budget leaves one piece untouched, so every
occurrence shows up as an exact piece hit. One automaton finds the hits of all pieces in a
whole document; each hit is verified with Myers' bit-parallel distance over the words around it.

Items are sent to the tasks in blocks of bounded size, whatever the size of the benchmark;
documents are scanned once for each block and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, text_hash

#: An item of m words may differ in m // BUDGET words.
BUDGET = 5
#: Characters of items in one block, which every task holds at once.
BLOCK_CHARS = 4_000_000

#: Scripts without spaces between words: each character counts as a word.
_SOLID = "\u0e00-\u0eff\u2e80-\u9fff\uf900-\ufaff"
_WORD = re.compile(rf"(?=\w)[{_SOLID}]|[^\W{_SOLID}]+")

SCHEMA = "doc_id bigint, item_id bigint, distance int, first_word bigint, last_word bigint, text_hash bigint"


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of word characters, and single characters of scripts that put no space between words."""
    return _WORD.findall((text or "").lower())


def pieces(m: int, budget: int) -> list[tuple[int, int]]:
    """``budget`` + 1 spans that cover m words, as even as can be."""
    n = budget + 1
    return [(i * m // n, (i + 1) * m // n) for i in range(n)]


def myers_search(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and that stretch's last index.

    Myers' algorithm in Hyyrö's form with Python integers as bit vectors; the pattern's end
    is one bit. The first of equally good ends wins; -1 is the empty stretch.
    """
    m = len(pattern)
    top, full = 1 << (m - 1), (1 << m) - 1
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    pv, mv, score = full, 0, m
    best, at = m, -1
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str | None]], budget: int = BUDGET):
        self.items: dict[int, list[str]] = {}
        starts: dict[str, list[tuple[int, int]]] = {}
        by_words: dict[tuple[str, ...], int] = {}
        self.ids: dict[int, set[int]] = {}
        self.budget = {}
        for item_id, text in items:
            words = words_of(text)
            if not words or item_id is None:
                continue
            key = by_words.setdefault(tuple(words), len(by_words))
            self.ids.setdefault(key, set()).add(item_id)
            if key in self.items:
                continue
            self.items[key], self.budget[key] = words, len(words) // budget
            for a, b in pieces(len(words), self.budget[key]):
                starts.setdefault(f" {' '.join(words[a:b])} ", []).append((key, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in starts.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, first word, last word) of the best occurrence of each item."""
        if not self.items or not (words := words_of(text)):
            return []
        plain = f" {' '.join(words)} "
        windows: dict[int, list[list[int]]] = {}
        seen, before = 0, 0
        for end, (size, where) in self.automaton.iter(plain):
            start = end - size + 1
            before += plain.count(" ", seen, start) if start >= seen else -plain.count(" ", start, seen)
            seen = start
            for key, offset in where:
                k, m = self.budget[key], len(self.items[key])
                lo, hi = max(0, before - offset - k), min(len(words), before - offset + m + k)
                spans = windows.setdefault(key, [])
                if spans and lo <= spans[-1][1] and spans[-1][0] <= lo:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
        found = []
        for key, spans in windows.items():
            pattern, best = self.items[key], None
            for lo, hi in spans:
                distance, at = myers_search(pattern, words[lo:hi])
                if distance <= self.budget[key] and (best is None or (distance, lo + at) < best[:2]):
                    back, length = myers_search(pattern[::-1], words[lo : lo + at + 1][::-1])
                    best = (distance, lo + at, lo + at - length if back == distance else lo)
            if best:
                found += [(i, best[0], best[2], best[1]) for i in self.ids[key]]
        return found


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, first_word, last_word, text_hash: each item that a document holds.

    One row for each pair of a row of ``docs`` and an item, at its best occurrence; words
    count from 0. Items of fewer than five words match where they occur exactly. Items without words, null
    items and items with a null id match nothing; equal items are reported each under its own id, repeated rows of one item once.
    Null and empty documents hold nothing. Repeated documents are reported each; an empty
    table gives an empty result. Other columns are ignored.
    """
    spark, found = docs.sparkSession, None
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def make(shared=shared) -> Callable[[list, list], Iterator[tuple]]:
            matcher = Matcher(shared.value)
            return lambda ids, texts: ((d, *m, text_hash(t)) for d, t in zip(ids, texts) for m in matcher.matches(t))

        part = per_text(docs, id_col, text_col, make, SCHEMA)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def item_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of about ``chars`` characters; the driver holds one partition at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("bigint"), "text").distinct().toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block
