from __future__ import annotations

import random

import pytest
import xxhash

from braid.llm import simhash

from .conftest import ids_of


def slow_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "É a b c\td", "x " * 400, "a\x1cb c d e f"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_long_texts_are_hashed_whole(monkeypatch):
    text = " ".join(str(i) for i in range(1000))
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def check(docs):
    rows = simhash.near_duplicates(docs).collect()
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(rows) == len(given)
    fps = [slow_fingerprint(t) for _, t in given]
    roots = components(fps)
    least = {}
    for (i, _), r in zip(given, roots):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    expected = sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(given, fps, roots)), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows), key=repr) == expected


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_documents(documents):
    check(documents)


def test_empty(no_docs):
    assert ids_of(simhash.near_duplicates(no_docs)) == []


@pytest.mark.parametrize("shard", [1024, 4])
def test_links_lose_nothing(spark, shard):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(40)]
    for base in list(fps[:12]):  # chains and dense clouds around a few centres
        for _ in range(25):
            x = base
            for b in r.sample(range(64), r.choice([1, 2, 3, 4])):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    roots = {r["node"]: r["root"] for r in simhash.connected_components(simhash.links(nodes, 2, shard)).collect()}
    got, expected = {}, {}
    for f, c in zip(fps, components(fps)):
        expected.setdefault(c, set()).add(f)
        got.setdefault(roots.get(simhash._signed(f), simhash._signed(f)), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_tree_follows_the_radius():
    r, tree = random.Random(1), simhash.BKTree()
    values = [r.getrandbits(10) for _ in range(200)]
    for v in values:
        tree.add(v)
    for q in range(0, 1024, 37):
        assert sorted(set(tree.within(q, 2))) == sorted({v for v in values if (v ^ q).bit_count() <= 2})
