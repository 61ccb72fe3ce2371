"""Edit-aware token counts.

A document is a segment tree over blocks of its pre-tokens: each leaf holds a stretch of text
that ends at white space and its token count, each inner node the characters and tokens
below it. An edit finds its first and last leaf by character sums, replaces the text there,
takes in a neighbour only where the new text would join its border, encodes that region
again and updates the sums on the paths to the root. Nothing else is encoded a second time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import per_text
from .encode import WordEncoder, encoder, tokenizer_path

#: Characters of a leaf, up to the next white space.
LEAF = 512

_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_SPACE = " \t\n\x0b\x0c\r"


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    """Stretches of about ``size`` characters whose cuts follow white space."""
    found, at = [], 0
    while at < len(text):
        gap = _SPACES.search(text, at + size)
        end = gap.end() if gap else len(text)
        found.append(text[at:end])
        at = end
    return found


class TokenTree:
    """Token count of one text under edits. ``encoded`` counts the characters encoded so far."""

    def __init__(self, text: str | None, words: WordEncoder, size: int = LEAF):
        self.words, self.size = words, size
        self._build(leaves_of(text or "", size))
        self.encoded = len(text or "")

    def _count(self, texts: list[str]) -> list[int]:
        split = [t.encode("utf-8", "replace").split() for t in texts]
        flat = [w for ws in split for w in ws]
        if not flat:
            return [0] * len(texts)
        sums = np.concatenate(([0], np.cumsum(self.words.counts(flat))))
        ends = np.cumsum([len(ws) for ws in split])
        return (sums[ends] - sums[ends - [len(ws) for ws in split]]).tolist()

    def _build(self, leaves: list[str]) -> None:
        self.leaves, self.base = leaves, 1
        while self.base < len(leaves):
            self.base *= 2
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        self.chars[self.base : self.base + len(leaves)] = map(len, leaves)
        self.tokens[self.base : self.base + len(leaves)] = self._count(leaves)
        for node in range(self.base - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self.base + leaf
        self.chars[node], self.tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            self._sum(node)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds character ``char``, the last one at the end, and where it begins."""
        node, before = 1, 0
        while node < self.base:
            node *= 2
            if char >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.base, before

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace characters ``start`` to ``end`` by ``text``; both are clipped to the text."""
        start = min(max(0, start), self.chars[1])
        end = min(max(start, end), self.chars[1])
        if not self.leaves:
            self._build(leaves_of(text, self.size))
            self.encoded += len(text)
            return
        first, at = self._leaf_at(start)
        last, last_at = self._leaf_at(max(start, end - 1))
        region = self.leaves[first][: start - at] + text + self.leaves[last][end - last_at :]
        first, last, region = self._with_context(first, last, region)
        if len(region) > 8 * self.size:
            self._build([*self.leaves[:first], *leaves_of(region, self.size), *self.leaves[last + 1 :]])
            self.encoded += self.chars[1]
            return
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._put(leaf, "", 0)
        self._put(first, region, self._count([region])[0])
        self.encoded += len(region)

    def _with_context(self, first: int, last: int, region: str) -> tuple[int, int, str]:
        """Take in neighbours while a border of the region lies inside a pre-token."""
        while (left := next((i for i in range(first - 1, -1, -1) if self.leaves[i]), None)) is not None:
            if region and region[0] in _SPACE or self.leaves[left][-1] in _SPACE:
                break
            first, region = left, self.leaves[left] + region
        while (right := next((i for i in range(last + 1, len(self.leaves)) if self.leaves[i]), None)) is not None:
            if not region or region[-1] in _SPACE or self.leaves[right][0] in _SPACE:
                break
            last, region = right, region + self.leaves[right]
        return first, last, region


def revisions(text: str) -> list[tuple[int, int, str]]:
    """The edits of the registered query: a heading, a changed middle, a cut and an ending."""
    n = len(text)
    return [(0, 0, "Revised. "), (n // 2, n // 2 + 7, "amended part"), (n // 3, n // 3 + 3, ""), (n + 32, n + 32, " End.")]


def edited_counts(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = revisions, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, edited_tokens, n_chars, reencoded_chars for every row of ``docs``.

    ``edits(text)`` lists (start, end, replacement), applied in turn. Null text counts as
    empty and is edited like any other; repeated rows and null ids are counted each. An
    empty table gives an empty result; other columns are ignored.
    """
    path = path or tokenizer_path()

    def make() -> Callable[[list, list], Iterator[tuple]]:
        words = encoder(path)

        def of(ids: list, texts: list) -> Iterator[tuple]:
            for doc_id, text in zip(ids, texts):
                tree = TokenTree(text, words)
                before, done = tree.total, tree.encoded
                for edit in edits(text or ""):
                    tree.edit(*edit)
                yield doc_id, before, tree.total, len(text or ""), tree.encoded - done

        return of

    return per_text(docs, id_col, text_col, make, "doc_id bigint, n_tokens bigint, edited_tokens bigint, n_chars bigint, reencoded_chars bigint")
