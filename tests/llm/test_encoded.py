"""Operators on token ids: shards, packing, edit-aware counts."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from braid.llm import encode, packing, sstable, tokens

from .conftest import ids_of


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(encode.tokenizer_path())


def whole(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_library(library, texts, monkeypatch):
    odd = ["", "<|endoftext|>a b<|endoftext|>", "don't DON'T 's", "İ ΑΣ ﬁ é é ß ẞ", "a\x1cb\x85c d", "12ab_##!!(x)", "ÀÖØÞ÷×ÿ", "tab\tnew\nline", "あ 日本"]
    monkeypatch.setattr(encode, "MEMORY", 500)  # forgets many times on the way
    words = encode.WordEncoder(encode.tokenizer_path())
    for text in odd + list(texts.values())[:80]:
        assert words.encode_ended(text).tolist() == whole(library, text)


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(r)
    return out


def test_shards_round_trip(library, odd_docs, no_docs):
    given = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in odd_docs.collect()), key=lambda x: x[:2])
    rows = sorted(sstable.round_trip(odd_docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [i if known else None for known, i, _ in given]
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    expected = sorted((i if known else -1, len(ids := whole(library, t)), encode.crc(np.array(ids))) for known, i, t in given)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == expected
    assert sstable.round_trip(no_docs).isEmpty()


def test_lookup(library, documents, texts):
    manifest = sstable.write_shards(documents, shard_bytes=1 << 15)
    shards = []
    for r in manifest.orderBy("task", "shard").collect():
        fs, path = pafs.FileSystem.from_uri(f"{r['folder']}/{r['file']}")
        shards.append(sstable.Shard(fs.open_input_file(path)))
    assert len(shards) > 1
    for doc_id in list(texts)[::17]:
        assert [a.tolist() for s in shards for a in s.get(doc_id)] == [whole(library, texts[doc_id])]
    absent = range(10**7, 10**7 + 500)
    assert not [1 for i in absent for s in shards if s.get(i)]
    assert sum(s.may_hold(sstable.key_of(i)) for i in absent for s in shards) < 0.05 * 500 * len(shards)


def test_keys_sort_like_ids():
    ids = [None, -(2**63), -5, 0, 3, 255, 256, 2**62]
    keys = [sstable.key_of(i) for i in ids]
    assert keys == sorted(keys) and [sstable.id_of(k) for k in keys] == ids


def check_packing(rows, given, library, capacity):
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    expected = defaultdict(list)
    for doc_id, text in given:
        ids = whole(library, text)
        expected[doc_id] += [(k, s, len(ids[s : s + capacity]), encode.crc(np.array(ids[s : s + capacity]))) for k, s in enumerate(range(0, len(ids), capacity))]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    laid = defaultdict(list)
    for r in rows:
        laid[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in laid.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(laid)


def best_fit(lengths, capacity):
    from bisect import bisect_left, insort

    free = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(free, n)
        insort(free, (free.pop(at) if at < len(free) else capacity) - n)
    return len(free)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(library, odd_docs, capacity):
    rows = packing.pack(odd_docs, capacity=capacity).collect()
    made = check_packing(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], library, capacity)
    assert made == best_fit([r["length"] for r in rows], capacity)


def test_packing_documents(library, documents, texts, no_docs):
    rows = packing.pack(documents.repartition(5)).collect()
    made = check_packing(rows, texts.items(), library, 4096)
    assert made == best_fit([r["length"] for r in rows], 4096)
    assert packing.pack(no_docs).isEmpty()


def test_plan_is_best_fit():
    r = random.Random(2)
    for capacity in (10, 97, 4096):
        lengths = [min(capacity, 1 + int(r.lognormvariate(np.log(capacity / 4), 1))) for _ in range(4000)]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        slots = packing.plan(histogram, capacity)
        assert max(s[2] for s in slots) < best_fit(lengths, capacity)


def test_edits_equal_full_counts(library):
    r, words = random.Random(1), encode.encoder(encode.tokenizer_path())
    bits = ["a", "bc ", " ", "\n", "don't", "é", "12", "..", "x y z", "", "Ünï "]
    for _ in range(40):
        text = "".join(r.choice(bits) for _ in range(r.choice([0, 1, 5, 300])))
        tree = tokens.TokenTree(text, words, r.choice([1, 4, 64]))
        for _ in range(8):
            a = r.randrange(len(text) + 1)
            b, new = min(len(text), a + r.choice([0, 1, 3, 50])), "".join(r.choice(bits) for _ in range(r.choice([0, 1, 3, 60])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text and tree.total == len(whole(library, text)) - 1


def test_only_the_region_is_encoded_again():
    words = encode.encoder(encode.tokenizer_path())
    tree = tokens.TokenTree("some words here " * 20_000, words)
    before = tree.encoded
    tree.edit(100_000, 100_004, "changed")
    assert tree.encoded - before < 4 * tokens.LEAF


def test_edited_counts(library, odd_docs, no_docs):
    rows = tokens.edited_counts(odd_docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == sorted((r["doc_id"] or 0, len(whole(library, r["text"])) - 1) for r in odd_docs.collect())

    def edited(text):
        for a, b, new in tokens.revisions(text):
            text = text[:a] + new + text[b:]
        return text

    assert sorted((r["doc_id"] or 0, r["edited_tokens"]) for r in rows) == sorted((r["doc_id"] or 0, len(whole(library, edited(r["text"] or ""))) - 1) for r in odd_docs.collect())
    assert ids_of(tokens.edited_counts(no_docs)) == []
