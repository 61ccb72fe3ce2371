"""Fast encoding of whole texts with a tokenizer file of the tokenizers library.

No token of the word vocabulary spans white space, so a text is encoded word by word, and
the library is asked once for each distinct word that a worker meets. Words that are plain
letters followed by plain punctuation are asked for as two parts, which keeps the memory of
words small. The memory of words has a fixed bound and starts again when it is full.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib
from collections.abc import Sequence

import numpy as np

TOKENIZER_FILE = "word_bpe_49k.json"
#: The id that ends each document.
END = 1
#: Remembered words, their ids and punctuation, at most, before the memory starts again.
MEMORY, MEMORY_IDS, TAILS = 700_000, 4_000_000, 10_000

#: Letters whose lower case and normal form are one character each, then punctuation that no letter joins.
_PARTS = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!#$%&()*+,./:;=?@\[\\\]^_`{|}~\"-]*)")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Such punctuation as ends most words; a shorter way to the same parts.
_ENDS = b".,:;!?"

#: How a byte-level vocabulary writes bytes: printable ones as themselves, others from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def _put(into: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``values`` written at ``at``, in a larger array if need be."""
    if at + len(values) > len(into):
        into = np.concatenate((into, np.zeros(max(len(into), len(values)), into.dtype)))
    into[at : at + len(values)] = values
    return into


class WordEncoder:
    """Ids of texts, from remembered ids of their words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces_of = self.tokenizer.model.tokenize
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.tails: dict[bytes, list[int]] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.n_ids = self.n_words = 0

    def _ask(self, texts: Sequence[bytes]) -> list[list[int]]:
        plain = [t.decode("utf-8", "replace") for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch(plain, add_special_tokens=False)]

    def _ids_of_part(self, part: bytes) -> list[int]:
        """Ids of one pre-token in lower case, straight from the library's model."""
        signs = part.decode() if part.isascii() else part.decode("latin-1").translate(_BYTE_SIGNS)
        return [t.id for t in self.pieces_of(signs)]

    def _learn(self, words: list[bytes]) -> None:
        known, rows, odd = self.known, [], []
        for w in words:
            if w.isalpha():
                a, b = w, b""
            elif w[-1] in _ENDS and w[:-1].isalpha():
                a, b = w[:-1], w[-1:]
            elif (m := _PARTS.fullmatch(w)) is None:
                odd.append(len(rows))
                rows.append([])
                continue
            else:
                a, b = m.groups()
            at = known.get(a) if b else None
            if at is None:
                ids = self._ids_of_part(a.lower() if a.isascii() else a.decode().lower().encode())
            else:
                ids = self.ids[self.starts[at] : self.starts[at] + self.sizes[at]].tolist()
            if b:
                if b not in self.tails:
                    if len(self.tails) > TAILS:
                        self.tails.clear()
                    self.tails[b] = self._ids_of_part(b)
                ids = ids + self.tails[b]
            rows.append(ids)
        for i, ids in zip(odd, self._ask([words[i] for i in odd]) if odd else []):
            rows[i] = ids
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.fromiter(itertools.chain.from_iterable(rows), np.uint32, int(sizes.sum()))
        self.ids = _put(self.ids, self.n_ids, ids)
        self.sizes = _put(self.sizes, self.n_words, sizes)
        self.starts = _put(self.starts, self.n_words, self.n_ids + np.cumsum(sizes) - sizes)
        self.known.update(zip(words, range(self.n_words, self.n_words + len(words))))
        self.n_ids += len(ids)
        self.n_words += len(words)

    def word_rows(self, words: list[bytes]) -> np.ndarray:
        """A number for each word, to look up in ``starts`` and ``sizes``."""
        new = set(words).difference(self.known)
        if new:
            if self.n_words > MEMORY or self.n_ids > MEMORY_IDS:
                self._forget()
                new = set(words)
            self._learn(list(new))
        return np.array(list(map(self.known.__getitem__, words)), np.int64)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of ids of each word."""
        rows = self.word_rows(words)  # may move the arrays
        return self.sizes[rows]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text, as unsigned 32-bit integers."""
        words = (text or "").encode("utf-8", "replace").split()
        if not words:
            return np.zeros(0, np.uint32)
        rows = self.word_rows(words)
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends + sizes, sizes)
        return self.ids[at]

    def encode_ended(self, text: str | None) -> np.ndarray:
        return np.append(self.encode(text), np.uint32(END)).astype("<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and tokenizer file."""
    return WordEncoder(path)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
