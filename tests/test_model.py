"""Random graphs against an independent model in plain Python, and laws that results obey."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from .test_graph import edges, graph


def random_edges(seed, n):
    r = random.Random(seed)
    return [([r.randrange(n) for _ in range(r.choice([1, 1, 2, 3, 5, 8]))], r.randrange(4)) for _ in range(25)]


def cheapest(given, source):
    """Bellman-Ford over (distance, hops)."""
    best = {source: (0, 0)}
    for _ in range(40):
        for vs, c in given:
            for a, b in zip(vs, vs[1:]):
                if a in best:
                    new = (best[a][0] + c, best[a][1] + 1)
                    if b not in best or new < best[b]:
                        best[b] = new
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_against_model(spark, seed):
    n, given = 9, random_edges(seed, 9)
    g = graph(spark, [str(i) for i in range(n)], given)
    pairs = Counter((a, b) for vs, _ in given for a, b in zip(vs, vs[1:]))
    assert {(r["src"], r["dst"]): r["count"] for r in g.links().groupBy("src", "dst").count().collect()} == pairs
    assert {tuple(r) for r in g.adjacency_from().collect()} == set(pairs)
    assert {(b, a) for a, b in pairs} == {tuple(r) for r in g.adjacency_to().collect()}
    out = {r["vertex_id"]: r["degree"] for r in g.degrees_out().collect()}
    into = {r["vertex_id"]: r["degree"] for r in g.degrees_in().collect()}
    assert out == {v: sum(c for (a, _), c in pairs.items() if a == v) for v in range(n)}
    assert sum(out.values()) == sum(into.values()) == sum(len(vs) - 1 for vs, _ in given)
    found = {r["vertex_id"]: (r["distance"], r["hops"]) for r in g.distances(0).collect()}
    assert found == cheapest(given, 0)


def test_laws(spark):
    from pyspark.sql import functions as F

    given = random_edges(5, 6)
    g = graph(spark, [str(i) for i in range(6)], given)
    twice = g.hyperedges.withColumn("vertices", F.reverse(F.reverse("vertices")))
    assert {r["hyperedge_id"]: list(r["vertices"]) for r in twice.collect()} == edges(g)
    assert g.intersection([0, 1, 2]) == g.intersection([2, 0, 1])
    gone = g.remove_vertex(3)
    assert edges(gone) == {h: w for h, vs in edges(g).items() if (w := [v for v in vs if v != 3])}
