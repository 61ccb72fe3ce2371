"""Scenarios on small named graphs: every read, every mutation, every refusal."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from braid import errors as E
from braid.graph import Graph

NAME = T.StructType([T.StructField("name", T.StringType())])
COSTED = T.StructType([T.StructField("name", T.StringType()), T.StructField("cost", T.LongType())])


def graph(spark, names, edges):
    v = spark.createDataFrame([(i, (n,)) for i, n in enumerate(names)], T.StructType([T.StructField("vertex_id", T.LongType(), False), T.StructField("weight", NAME, False)]))
    schema = T.StructType(
        [T.StructField("hyperedge_id", T.LongType(), False), T.StructField("vertices", T.ArrayType(T.LongType(), False), False), T.StructField("weight", COSTED, False), T.StructField("cost", T.LongType(), False)]
    )
    h = spark.createDataFrame([(i, vs, (f"e{i}", c), c) for i, (vs, c) in enumerate(edges)], schema)
    return Graph.of(v.coalesce(1), h.coalesce(1))


@pytest.fixture(scope="module")
def main(spark):
    return graph(spark, ["Andrea", "Bjorn", "Charlie", "Dana", "Enola"], [([0, 1, 1, 3], 1), ([0, 1, 1, 3], 1), ([4, 0, 3, 2], 2), ([3], 10), ([3], 20)])


@pytest.fixture(scope="module")
def letters(spark):
    return graph(spark, list("abcde"), [([0, 1, 2, 3, 4], 1), ([0, 2, 3, 4, 2], 1), ([0, 4, 1], 1), ([1, 2, 1, 3, 2], 1), ([2, 2, 2], 1)])


def edges(g):
    return {r["hyperedge_id"]: list(r["vertices"]) for r in g.hyperedges.collect()}


def test_counts_and_lookups(main):
    assert (main.count_vertices(), main.count_hyperedges()) == (5, 5)
    assert main.vertex_weight(4)["name"] == "Enola"
    assert tuple(main.hyperedge_weight(4)) == ("e4", 20)
    assert main.hyperedge_vertices(0) == [0, 1, 1, 3]
    for call, wrong in ((main.vertex_weight, E.VertexNotFound(vertex=5)), (main.hyperedge_weight, E.HyperedgeNotFound(hyperedge=5)), (main.hyperedge_vertices, E.HyperedgeNotFound(hyperedge=5))):
        with pytest.raises(type(wrong)) as got:
            call(5)
        assert got.value == wrong


def test_memberships(main):
    assert [main.vertex_hyperedges(v) for v in range(5)] == [[0, 1, 2], [0, 1], [2], [0, 1, 2, 3, 4], [2]]
    assert main.full_vertex_hyperedges(3) == [[0, 1, 1, 3], [0, 1, 1, 3], [4, 0, 3, 2], [3], [3]]
    bulk = {}
    for r in main.memberships().collect():
        bulk.setdefault(r["vertex_id"], []).append(r["hyperedge_id"])
    assert {v: sorted(h) for v, h in bulk.items()} == {v: main.vertex_hyperedges(v) for v in range(5)}
    with pytest.raises(E.VertexNotFound):
        main.vertex_hyperedges(5)


def test_intersections(main):
    assert main.intersection([0, 2]) == [0, 3]
    assert main.intersection([0, 2, 3]) == [3]
    assert main.intersection([0, 0]) == [0, 1, 3]
    for few in ([], [0]):
        with pytest.raises(E.TooFewToIntersect):
            main.intersection(few)
    with pytest.raises(E.HyperedgeNotFound) as got:
        main.intersection([5, 6])
    assert got.value.hyperedge == 5


def test_adjacency(main):
    assert [main.adjacent_from(v) for v in range(4)] == [[1, 3], [1, 3], [], [2]]
    assert [main.adjacent_to(v) for v in range(4)] == [[4], [0, 1], [3], [0, 1]]
    assert main.full_adjacent_from(0) == [(1, [0, 1]), (3, [2])]
    assert main.full_adjacent_from(1) == [(1, [0, 1]), (3, [0, 1])]
    assert main.full_adjacent_from(2) == []
    assert main.full_adjacent_to(1) == [(0, [0, 1]), (1, [0, 1])]
    assert main.full_adjacent_to(3) == [(0, [2]), (1, [0, 1])]
    for call in (main.adjacent_from, main.adjacent_to, main.full_adjacent_from, main.full_adjacent_to):
        with pytest.raises(E.VertexNotFound):
            call(5)


def test_connecting(main):
    assert main.hyperedges_connecting(1, 1) == [0, 1]
    assert main.hyperedges_connecting(4, 0) == [2]
    assert main.hyperedges_connecting(3, 0) == []
    assert main.hyperedges_connecting(0, 5) == []  # only the first end must exist
    with pytest.raises(E.VertexNotFound):
        main.hyperedges_connecting(5, 0)


def test_degrees(main):
    assert [main.degree_out(v) for v in range(5)] == [3, 4, 0, 1, 1]
    assert [main.degree_in(v) for v in range(5)] == [1, 4, 1, 3, 0]
    assert sorted(tuple(r) for r in main.degrees_in().collect()) == [(0, 1), (1, 4), (2, 1), (3, 3), (4, 0)]


def test_shortest_paths(main):
    assert main.shortest_path(4, 1) == [(4, None), (0, 2), (1, 0)]
    assert main.shortest_path(0, 3) == [(0, None), (3, 2)]
    assert main.shortest_path(0, 4) == []
    assert main.shortest_path(3, 3) == [(3, None)]
    with pytest.raises(E.VertexNotFound):
        main.shortest_path(3, 5)


@pytest.mark.parametrize(
    ("n", "given", "ends", "expected"),
    [
        (5, [([0, 1, 4], 10), ([0, 1, 4, 3], 20), ([1, 2, 4], 1), ([1, 3], 100)], (0, 3), [(0, None), (1, 0), (2, 2), (4, 2), (3, 1)]),
        (2, [([0, 1], 10), ([0, 1], 2)], (0, 1), [(0, None), (1, 1)]),
        (4, [([0, 1], 1), ([1, 2], 1), ([0, 3], 5)], (0, 3), [(0, None), (3, 2)]),
        (4, [([0, 1, 3], 1), ([0, 2, 3], 1)], (0, 3), [(0, None), (1, 0), (3, 0)]),
        (3, [([0, 1, 0], 0), ([1, 2], 0)], (0, 2), [(0, None), (1, 0), (2, 1)]),
    ],
)
def test_path_choices(spark, n, given, ends, expected):
    assert graph(spark, [str(i) for i in range(n)], given).shortest_path(*ends) == expected


def test_mutation_script(spark, main):
    g = main.update_vertex_weight(1, ("Bjorg",))
    with pytest.raises(E.VertexWeightUnchanged):
        g.update_vertex_weight(1, ("Bjorg",))
    with pytest.raises(E.VertexWeightTaken):
        g.update_vertex_weight(1, ("Dana",))
    g = g.update_hyperedge_weight(4, ("sleep", 0), 0)
    with pytest.raises(E.HyperedgeWeightUnchanged):
        g.update_hyperedge_weight(4, ("sleep", 0), 0)
    with pytest.raises(E.HyperedgeWeightTaken):
        g.update_hyperedge_weight(0, ("e3", 10), 10)
    g = g.update_hyperedge_vertices(0, [0, 4])
    assert [g.vertex_hyperedges(v) for v in (0, 1, 3, 4)] == [[0, 1, 2], [1], [1, 2, 3, 4], [0, 2]]
    for args, wrong in (((5, [1]), E.HyperedgeNotFound), ((0, []), E.NoVerticesToUpdate), ((0, [0, 4]), E.HyperedgeVerticesUnchanged), ((0, [9]), E.VertexNotFound)):
        with pytest.raises(wrong):
            g.update_hyperedge_vertices(*args)
    g = g.remove_hyperedge(4).remove_hyperedge(0)
    with pytest.raises(E.HyperedgeNotFound):
        g.remove_hyperedge(0)
    g = g.remove_vertex(4)
    assert edges(g) == {1: [0, 1, 1, 3], 2: [0, 3, 2], 3: [3]}
    g = g.remove_vertex(0)
    assert edges(g) == {1: [1, 1, 3], 2: [3, 2], 3: [3]}
    g = g.reverse_hyperedge(1)
    assert g.hyperedge_vertices(1) == [3, 1, 1]
    assert (g.degree_in(2), g.degree_out(2), g.degree_in(3), g.degree_out(3)) == (1, 0, 0, 2)
    g = g.clear_hyperedges()
    assert (g.count_vertices(), g.count_hyperedges(), g.vertex_hyperedges(3)) == (3, 0, [])
    g, h = g.add_hyperedge([3], ("again", 0), 0)
    assert h == 0
    g = g.clear()
    assert (g.count_vertices(), g.count_hyperedges(), g.next_vertex_id) == (0, 0, 0)
    assert edges(main)[0] == [0, 1, 1, 3]  # handles never change


def test_remove_vertex_held_by_several_unaries(main):
    assert edges(main.remove_vertex(3)) == {0: [0, 1, 1], 1: [0, 1, 1], 2: [4, 0, 2]}


def test_contraction(letters):
    g, sequence = letters.contract(0, [1, 2], 1)
    assert sequence == [0, 1, 3, 4]
    assert edges(g) == {0: [0, 1, 3, 4], 1: [0, 1, 3, 4, 1], 2: [0, 4, 1], 3: [1, 3, 1], 4: [1]}
    assert g.vertex_hyperedges(2) == [] and g.count_vertices() == 5
    again, _ = g.contract(0, [1], 1)
    assert edges(again) == edges(g)
    with pytest.raises(E.HyperedgeNotFound):
        letters.contract(5, [1], 1)
    with pytest.raises(E.ContractionTargetMissing) as got:
        letters.contract(0, [3, 4], 0)
    assert got.value == E.ContractionTargetMissing(hyperedge=0, target=0, vertices=[3, 4])
    with pytest.raises(E.ContractionVerticesMissing) as got:
        letters.contract(0, [5, 6], 5)
    assert got.value == E.ContractionVerticesMissing(hyperedge=0, vertices=[5, 6])


def test_contraction_leaves_other_edges(spark):
    g, sequence = graph(spark, list("abcd"), [([1, 2], 1), ([3, 3, 1], 1), ([3, 3], 1)]).contract(0, [1, 2], 1)
    assert sequence == [1] and edges(g) == {0: [1], 1: [3, 1], 2: [3, 3]}


def test_join(letters):
    g = letters.join([3, 1, 4])
    assert edges(g) == {0: [0, 1, 2, 3, 4], 2: [0, 4, 1], 3: [1, 2, 1, 3, 2, 0, 2, 3, 4, 2, 2, 2, 2]}
    for args, wrong in (([3], E.TooFewToJoin), ([3, 3], E.RepeatedInJoin), ([3, 9], E.HyperedgeNotFound)):
        with pytest.raises(wrong):
            letters.join(args)


def test_repeats_and_palindromes(spark):
    g = graph(spark, list("ab"), [([1, 1, 1], 1), ([0, 1, 0], 1)])
    assert g.hyperedges_connecting(1, 1) == [0, 0]
    assert g.full_adjacent_from(1) == [(0, [1]), (1, [0, 0])]
    with pytest.raises(E.HyperedgeVerticesUnchanged):
        g.reverse_hyperedge(1)


def test_materialize(spark):
    g = graph(spark, ["one", "two", "three", "four", "five"], [([0, 1, 2], 10), ([3, 4], 20), ([2, 2, 2], 1), ([4, 3, 2, 0], 100)])
    rows = {r["weight"]["cost"]: [w["name"] for w in r["vertex_weights"]] for r in g.materialized().collect()}
    assert rows == {10: ["one", "two", "three"], 20: ["four", "five"], 1: ["three"] * 3, 100: ["five", "four", "three", "one"]}


def test_growing_from_empty(spark):
    g = Graph.new(spark, T.StringType(), T.StringType(), 10, 10)
    assert (g.count_vertices(), g.count_hyperedges()) == (0, 0)
    for i, name in enumerate(["a", "b"]):
        g, v = g.add_vertex(name)
        assert v == i
    with pytest.raises(E.VertexWeightTaken):
        g.add_vertex("a")
    g, h = g.add_hyperedge([0, 1, 1], "x", 3)
    assert (h, g.hyperedge_vertices(0)) == (0, [0, 1, 1])
    for args, wrong in ((([], "y", 1), E.NoVerticesToCreate), (([9], "y", 1), E.VertexNotFound), (([1], "x", 1), E.HyperedgeWeightTaken), (([1], "y", -1), E.InvalidWeight)):
        with pytest.raises(wrong):
            g.add_hyperedge(*args)
    g = g.remove_hyperedge(0)
    g, h = g.add_hyperedge([1], "z", 0)
    assert h == 1  # ids are not used again


def test_bulk_ingest(spark):
    g = Graph.new(spark, T.LongType(), T.LongType())
    g = g.add_vertices(spark.range(0, 500, 1, 7).selectExpr("id * 3 as weight"), ["weight"])
    assert [tuple(r) for r in g.vertices.orderBy("vertex_id").collect()] == [(i, 3 * i) for i in range(500)]
    rows = spark.range(0, 200, 1, 5).selectExpr("array(id, id + 1) as vertices", "id as weight", "id as cost")
    g = g.add_hyperedges(rows, ["weight"])
    assert g.next_hyperedge_id == 200 and g.hyperedge_vertices(150) == [150, 151]
    assert g.weight_violations().isEmpty()
    with pytest.raises(E.VertexWeightTaken):
        g.add_vertices(spark.range(1).selectExpr("id as weight"), ["weight"])
    with pytest.raises(E.VertexNotFound):
        g.add_hyperedges(spark.range(1).selectExpr("array(9999L) as vertices", "777L as weight", "0L as cost"), ["weight"])


def test_null_weights_are_refused_in_bulk(spark):
    g = Graph.new(spark, T.StringType(), T.LongType())
    with pytest.raises(E.InvalidWeight):
        g.add_vertices(spark.createDataFrame([("a",), (None,)], "weight string"), ["weight"])
    g = g.add_vertices(spark.createDataFrame([("a",)], "weight string"), ["weight"])
    with pytest.raises(E.InvalidWeight):
        g.add_hyperedges(spark.createDataFrame([([0], None, 1)], "vertices array<bigint>, weight bigint, cost bigint"), ["cost"])


def test_batch_edits(spark, letters):
    ids = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} bigint")
    assert edges(letters.remove_hyperedges(ids("hyperedge_id", [0, 2, 2, 99]))) == {1: [0, 2, 3, 4, 2], 3: [1, 2, 1, 3, 2], 4: [2, 2, 2]}
    assert edges(letters.reverse_hyperedges(ids("hyperedge_id", [1, 1, 4, 99]))) == {0: [0, 1, 2, 3, 4], 1: [2, 4, 3, 2, 0], 2: [0, 4, 1], 3: [1, 2, 1, 3, 2], 4: [2, 2, 2]}
    g = letters.remove_vertices(ids("vertex_id", [2, 3, 3, 99]))
    assert edges(g) == {0: [0, 1, 4], 1: [0, 4], 2: [0, 4, 1], 3: [1, 1]} and g.count_vertices() == 3
    assert edges(letters.remove_vertices(ids("vertex_id", []))) == edges(letters)


def test_bulk_neighbours_are_long_rows(letters):
    rows = letters.full_adjacency_from().where("vertex_id = 1").select("neighbour_id", "hyperedge_id", "pos").collect()
    assert sorted(map(tuple, rows)) == [(2, 0, 1), (2, 3, 0), (3, 3, 2)]


def test_weight_types(spark):
    for kind in (T.DoubleType(), T.StructType([T.StructField("x", T.FloatType())]), T.MapType(T.StringType(), T.LongType())):
        with pytest.raises(E.InvalidWeight):
            Graph.new(spark, kind, T.LongType())


def test_round_trip(spark, main, tmp_path):
    from braid.sources import tables

    tables.write(main, str(tmp_path))
    again = tables.read(spark, str(tmp_path))
    assert edges(again) == edges(main) and again.next_hyperedge_id == 5
