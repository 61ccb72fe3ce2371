"""Registered queries of the graph operators and the SQL that each must equal.

Results are in long form (one row for each place of a sequence), so that no array or order
has to be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from .graph import Graph
from .operators import adjacency, edit, intersect, paths, relations
from .sources import sample

#: Vertices and hyperedges that the point queries ask for.
PART, PARTS, NATION, TO_NATION, ORDER, ORDERS = 17, [3, 17, 42], 4, 16, 19, [5, 6, 17]

Query = Callable[[SparkSession, str], DataFrame]

_INC = """
WITH inc AS (
  SELECT l_orderkey AS hyperedge_id, l_partkey AS vertex_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS BIGINT) AS pos
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
), lk AS (
  SELECT * FROM (SELECT hyperedge_id, pos, vertex_id AS src,
                        lead(vertex_id) OVER (PARTITION BY hyperedge_id ORDER BY pos) AS dst FROM inc)
  WHERE dst IS NOT NULL
), cost AS (SELECT o_orderkey AS hyperedge_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cost FROM orders)
"""

_NAT = """
WITH RECURSIVE inc AS (
  SELECT l_orderkey AS hyperedge_id, CAST(s_nationkey AS BIGINT) AS vertex_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS pos
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
), cost AS (SELECT o_orderkey AS hyperedge_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cost FROM orders),
lk AS (
  SELECT hyperedge_id, src, dst, cost
  FROM (SELECT hyperedge_id, vertex_id AS src, lead(vertex_id) OVER (PARTITION BY hyperedge_id ORDER BY pos) AS dst FROM inc)
  JOIN cost USING (hyperedge_id) WHERE dst IS NOT NULL
)
"""

_EVT = """
WITH kind AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS vertex_id FROM (SELECT DISTINCT event_type FROM events)),
inc AS (
  SELECT user_id AS hyperedge_id, vertex_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos
  FROM events JOIN kind USING (event_type)
), lk AS (
  SELECT * FROM (SELECT hyperedge_id, pos, vertex_id AS src, lead(vertex_id) OVER (PARTITION BY hyperedge_id ORDER BY pos) AS dst FROM inc)
  WHERE dst IS NOT NULL
)
"""

_RENUMBER = "CAST(row_number() OVER (PARTITION BY hyperedge_id ORDER BY {order}) - 1 AS BIGINT) AS pos"


def _long(hyperedges: DataFrame) -> DataFrame:
    return relations.incidence(hyperedges).select("hyperedge_id", F.col("pos").cast("bigint").alias("pos"), "vertex_id")


def _parts_links(spark: SparkSession, d: str, **ends: int) -> DataFrame:
    return relations.links(sample.order_parts(spark, d), **ends)


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias(name))


def _graph(spark: SparkSession, d: str) -> Graph:
    """Parts and the orders that hold them."""
    return Graph.of(sample.parts(spark, d), sample.order_parts(spark, d))


def _sizes(graph: Graph) -> DataFrame:
    return graph.spark.createDataFrame([(graph.count_vertices(), graph.count_hyperedges())], "n_vertices bigint, n_hyperedges bigint")


def new_empty(spark: SparkSession, d: str) -> DataFrame:
    """Operators new, with_capacity, default."""
    return _sizes(Graph.new(spark, T.StringType(), T.LongType(), 10, 10))


def clear(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(_graph(spark, d).clear())


def clear_hyperedges(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(_graph(spark, d).clear_hyperedges())


def materialized(spark: SparkSession, d: str) -> DataFrame:
    rows = Graph(sample.parts(spark, d), sample.order_parts(spark, d), 0, 0).materialized()
    return rows.select("hyperedge_id", "weight.cost", F.posexplode("vertex_weights").alias("pos", "w")).select(
        "hyperedge_id", F.col("pos").cast("bigint").alias("pos"), "cost", "w.p_partkey", "w.p_name"
    )


def incidence(spark: SparkSession, d: str) -> DataFrame:
    return _long(sample.order_parts(spark, d))


def links(spark: SparkSession, d: str) -> DataFrame:
    return _parts_links(spark, d).withColumn("pos", F.col("pos").cast("bigint"))


def count_vertices(spark: SparkSession, d: str) -> DataFrame:
    return _count(sample.parts(spark, d), "n")


def count_hyperedges(spark: SparkSession, d: str) -> DataFrame:
    return _count(sample.order_parts(spark, d), "n")


def vertex_weight(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(PART, _graph(spark, d).vertex_weight(PART)["p_name"])], "vertex_id bigint, p_name string")


def hyperedge_weight(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(ORDER, _graph(spark, d).hyperedge_weight(ORDER)["cost"])], "hyperedge_id bigint, cost bigint")


def hyperedge_vertices(spark: SparkSession, d: str) -> DataFrame:
    return _long(sample.order_parts(spark, d).where(F.col("hyperedge_id") == ORDER))


def vertex_hyperedges(spark: SparkSession, d: str) -> DataFrame:
    return relations.memberships(sample.order_parts(spark, d))


def full_vertex_hyperedges(spark: SparkSession, d: str) -> DataFrame:
    return _long(sample.order_parts(spark, d).where(F.array_contains("vertices", PART)))


def adjacent_from(spark: SparkSession, d: str) -> DataFrame:
    return adjacency.neighbours(_parts_links(spark, d), "src", "dst")


def adjacent_to(spark: SparkSession, d: str) -> DataFrame:
    return adjacency.neighbours(_parts_links(spark, d, dst=PART), "dst", "src")


def adjacent_to_all(spark: SparkSession, d: str) -> DataFrame:
    return adjacency.neighbours(_parts_links(spark, d), "dst", "src")


def _long_links(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def full_adjacent_from(spark: SparkSession, d: str) -> DataFrame:
    return _long_links(adjacency.full_links(_parts_links(spark, d), "src", "dst"))


def full_adjacent_to(spark: SparkSession, d: str) -> DataFrame:
    return _long_links(adjacency.full_links(relations.links(sample.user_events(spark, d)), "dst", "src"))


def full_adjacent_to_one(spark: SparkSession, d: str) -> DataFrame:
    """The point form, with a list for each neighbour."""
    found = _graph(spark, d).full_adjacent_to(PART)
    rows = [(neighbour, nth, h) for neighbour, hyperedges in found for nth, h in enumerate(hyperedges)]
    return spark.createDataFrame(rows, "neighbour_id bigint, nth bigint, hyperedge_id bigint")


def hyperedges_connecting(spark: SparkSession, d: str) -> DataFrame:
    return relations.links(sample.order_nations(spark, d), NATION, TO_NATION).select("hyperedge_id")


def degree_in(spark: SparkSession, d: str) -> DataFrame:
    return adjacency.degrees(sample.parts(spark, d), _parts_links(spark, d), "dst")


def degree_out(spark: SparkSession, d: str) -> DataFrame:
    return adjacency.degrees(sample.parts(spark, d), _parts_links(spark, d), "src")


def intersections_two(spark: SparkSession, d: str) -> DataFrame:
    return intersect.intersection(sample.order_nations(spark, d), ORDERS[:2])


def intersections_three(spark: SparkSession, d: str) -> DataFrame:
    return intersect.intersection(sample.user_events(spark, d), [1, 2, 3])


def intersections_same(spark: SparkSession, d: str) -> DataFrame:
    return intersect.intersection(sample.order_nations(spark, d), [ORDER, ORDER])


def intersections_pairs(spark: SparkSession, d: str) -> DataFrame:
    return adjacency.pair_intersections(relations.memberships(sample.order_nations(spark, d)))


def add_vertex(spark: SparkSession, d: str) -> DataFrame:
    graph, _ = _graph(spark, d).add_vertex((0, "added"))
    return graph.vertices.select("vertex_id", "weight.p_name")


def add_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers join the parts as vertices, numbered in the order of their keys."""
    weights = sample.table(spark, d, "supplier").select(F.struct((-F.col("s_suppkey")).alias("p_partkey"), F.col("s_name").alias("p_name")).alias("weight"), "s_suppkey")
    return _graph(spark, d).add_vertices(weights, ["s_suppkey"]).vertices.select("vertex_id", "weight.p_name")


def add_hyperedge(spark: SparkSession, d: str) -> DataFrame:
    graph, _ = _graph(spark, d).add_hyperedge(PARTS, (0, 0), 0)
    return _long(graph.hyperedges)


def add_hyperedges(spark: SparkSession, d: str) -> DataFrame:
    """All orders enter a graph of parts at once, numbered by cost and key."""
    rows = sample.order_parts(spark, d)
    graph = _graph(spark, d).clear_hyperedges().add_hyperedges(rows.select("vertices", "weight", "cost", "hyperedge_id"), ["cost", "hyperedge_id"])
    return _long(graph.hyperedges)


def update_vertex_weight(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).update_vertex_weight(PART, (0, "renamed")).vertices.select("vertex_id", "weight.p_name")


def update_hyperedge_weight(spark: SparkSession, d: str) -> DataFrame:
    graph = _graph(spark, d).update_hyperedge_weight(ORDER, (0, 2), 1)
    return graph.hyperedges.select("hyperedge_id", F.col("weight.cost").alias("weight_cost"), "cost")


def update_hyperedge_vertices(spark: SparkSession, d: str) -> DataFrame:
    return _long(_graph(spark, d).update_hyperedge_vertices(ORDER, [*PARTS, PARTS[0]]).hyperedges)


def reverse_hyperedge(spark: SparkSession, d: str) -> DataFrame:
    return _long(_graph(spark, d).reverse_hyperedge(ORDER).hyperedges)


def _dear(spark: SparkSession, d: str) -> DataFrame:
    """hyperedge_id of the orders over a price, as a table of ids."""
    return sample.order_weights(spark, d).where("cost > 15000000").select("hyperedge_id")


def reverse_hyperedges(spark: SparkSession, d: str) -> DataFrame:
    return _long(Graph(sample.parts(spark, d), sample.order_parts(spark, d), 0, 0).reverse_hyperedges(_dear(spark, d)).hyperedges)


def remove_hyperedge(spark: SparkSession, d: str) -> DataFrame:
    return _long(edit.drop_hyperedges(sample.order_parts(spark, d), ORDERS))


def remove_hyperedges(spark: SparkSession, d: str) -> DataFrame:
    return _long(Graph(sample.parts(spark, d), sample.order_parts(spark, d), 0, 0).remove_hyperedges(_dear(spark, d)).hyperedges)


def remove_vertex(spark: SparkSession, d: str) -> DataFrame:
    return _long(edit.drop_vertices(sample.order_nations(spark, d), [NATION]))


def remove_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Without the nations of one region."""
    gone = sample.table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("bigint").alias("vertex_id"))
    return _long(Graph(sample.nations(spark, d), sample.order_nations(spark, d), 0, 0).remove_vertices(gone).hyperedges)


def contract_vertices(spark: SparkSession, d: str) -> DataFrame:
    return _long(edit.contract(sample.order_nations(spark, d), [NATION, TO_NATION, 11], NATION))


def join_hyperedges(spark: SparkSession, d: str) -> DataFrame:
    return _long(edit.concatenate(sample.order_parts(spark, d), ORDERS[::-1]))


def shortest_distances(spark: SparkSession, d: str) -> DataFrame:
    return paths.distances(relations.links(sample.order_nations(spark, d)), NATION).select("vertex_id", "distance", F.col("hops").cast("bigint").alias("hops"))


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    steps = paths.path(relations.links(sample.order_nations(spark, d)), NATION, TO_NATION)
    return spark.createDataFrame([(i, v, h) for i, (v, h) in enumerate(steps)], "step bigint, vertex_id bigint, via_hyperedge_id bigint")


def weight_violations(spark: SparkSession, d: str) -> DataFrame:
    """Parts by name alone, which repeats."""
    vertices = sample.parts(spark, d).select("vertex_id", F.col("weight.p_name").alias("weight"))
    graph = Graph(vertices, sample.order_parts(spark, d), 0, 0)
    return graph.weight_violations().select("kind", F.get_json_object("weight", "$.weight").alias("p_name"), "n")


_LIST = ", ".join(map(str, ORDERS))
_SQL: dict[Query, str] = {
    new_empty: "SELECT CAST(0 AS BIGINT) AS n_vertices, CAST(0 AS BIGINT) AS n_hyperedges",
    clear: "SELECT CAST(0 AS BIGINT) AS n_vertices, CAST(0 AS BIGINT) AS n_hyperedges",
    clear_hyperedges: "SELECT count(*) AS n_vertices, CAST(0 AS BIGINT) AS n_hyperedges FROM part",
    materialized: _INC + "SELECT hyperedge_id, pos, cost, p_partkey, p_name FROM inc JOIN cost USING (hyperedge_id) JOIN part ON vertex_id = p_partkey",
    incidence: _INC + "SELECT hyperedge_id, pos, vertex_id FROM inc",
    links: _INC + "SELECT hyperedge_id, pos, src, dst, cost FROM lk JOIN cost USING (hyperedge_id)",
    count_vertices: "SELECT count(*) AS n FROM part",
    count_hyperedges: "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)",
    vertex_weight: f"SELECT p_partkey AS vertex_id, p_name FROM part WHERE p_partkey = {PART}",
    hyperedge_weight: f"SELECT o_orderkey AS hyperedge_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cost FROM orders WHERE o_orderkey = {ORDER} AND o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    hyperedge_vertices: _INC + f"SELECT hyperedge_id, pos, vertex_id FROM inc WHERE hyperedge_id = {ORDER}",
    vertex_hyperedges: _INC + "SELECT DISTINCT vertex_id, hyperedge_id FROM inc",
    full_vertex_hyperedges: _INC + f"SELECT hyperedge_id, pos, vertex_id FROM inc WHERE hyperedge_id IN (SELECT hyperedge_id FROM inc WHERE vertex_id = {PART})",
    adjacent_from: _INC + "SELECT DISTINCT src AS vertex_id, dst AS neighbour_id FROM lk",
    adjacent_to_all: _INC + "SELECT DISTINCT dst AS vertex_id, src AS neighbour_id FROM lk",
    adjacent_to: _INC + f"SELECT DISTINCT dst AS vertex_id, src AS neighbour_id FROM lk WHERE dst = {PART}",
    full_adjacent_from: _INC + "SELECT src AS vertex_id, dst AS neighbour_id, hyperedge_id, pos FROM lk",
    full_adjacent_to: _EVT + "SELECT dst AS vertex_id, src AS neighbour_id, hyperedge_id, pos FROM lk",
    full_adjacent_to_one: _INC + f"SELECT src AS neighbour_id, CAST(row_number() OVER (PARTITION BY src ORDER BY hyperedge_id, pos) - 1 AS BIGINT) AS nth, hyperedge_id FROM lk WHERE dst = {PART}",
    hyperedges_connecting: _NAT + f"SELECT hyperedge_id FROM lk WHERE src = {NATION} AND dst = {TO_NATION}",
    degree_in: _INC + "SELECT p_partkey AS vertex_id, count(dst) AS degree FROM part LEFT JOIN lk ON dst = p_partkey GROUP BY 1",
    degree_out: _INC + "SELECT p_partkey AS vertex_id, count(src) AS degree FROM part LEFT JOIN lk ON src = p_partkey GROUP BY 1",
    intersections_two: _NAT + f"SELECT vertex_id FROM inc WHERE hyperedge_id IN ({ORDERS[0]}, {ORDERS[1]}) GROUP BY 1 HAVING count(DISTINCT hyperedge_id) = 2",
    intersections_three: _EVT + "SELECT vertex_id FROM inc WHERE hyperedge_id IN (1, 2, 3) GROUP BY 1 HAVING count(DISTINCT hyperedge_id) = 3",
    intersections_same: _NAT + f"SELECT DISTINCT vertex_id FROM inc WHERE hyperedge_id = {ORDER}",
    intersections_pairs: _NAT + "SELECT DISTINCT x.hyperedge_id AS a, y.hyperedge_id AS b, x.vertex_id FROM inc x JOIN inc y ON y.hyperedge_id = x.hyperedge_id + 1 AND x.vertex_id = y.vertex_id",
    add_vertex: "SELECT p_partkey AS vertex_id, p_name FROM part UNION ALL SELECT max(p_partkey) + 1, 'added' FROM part",
    add_vertices: "SELECT p_partkey AS vertex_id, p_name FROM part UNION ALL SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY s_suppkey), s_name FROM supplier",
    add_hyperedges: _INC + ", num AS (SELECT hyperedge_id, CAST(row_number() OVER (ORDER BY cost, hyperedge_id) - 1 AS BIGINT) AS id FROM cost WHERE hyperedge_id IN (SELECT hyperedge_id FROM inc)) SELECT id AS hyperedge_id, pos, vertex_id FROM inc JOIN num USING (hyperedge_id)",
    add_hyperedge: _INC + f"SELECT hyperedge_id, pos, vertex_id FROM inc UNION ALL SELECT m.h, p.pos, p.v FROM (SELECT max(hyperedge_id) + 1 AS h FROM inc) m, (VALUES (0, {PARTS[0]}), (1, {PARTS[1]}), (2, {PARTS[2]})) p(pos, v)",
    update_vertex_weight: f"SELECT p_partkey AS vertex_id, CASE WHEN p_partkey = {PART} THEN 'renamed' ELSE p_name END AS p_name FROM part",
    update_hyperedge_weight: _INC + f"SELECT hyperedge_id, CASE WHEN hyperedge_id = {ORDER} THEN 2 ELSE cost END AS weight_cost, CASE WHEN hyperedge_id = {ORDER} THEN 1 ELSE cost END AS cost FROM cost WHERE hyperedge_id IN (SELECT hyperedge_id FROM inc)",
    update_hyperedge_vertices: _INC + f"SELECT hyperedge_id, pos, vertex_id FROM inc WHERE hyperedge_id <> {ORDER} UNION ALL SELECT {ORDER}, p.pos, p.v FROM (VALUES (0, {PARTS[0]}), (1, {PARTS[1]}), (2, {PARTS[2]}), (3, {PARTS[0]})) p(pos, v)",
    reverse_hyperedge: _INC + f"SELECT hyperedge_id, CASE WHEN hyperedge_id = {ORDER} THEN max(pos) OVER (PARTITION BY hyperedge_id) - pos ELSE pos END AS pos, vertex_id FROM inc",
    reverse_hyperedges: _INC + "SELECT hyperedge_id, CASE WHEN cost > 15000000 THEN max(pos) OVER (PARTITION BY hyperedge_id) - pos ELSE pos END AS pos, vertex_id FROM inc JOIN cost USING (hyperedge_id)",
    remove_hyperedges: _INC + "SELECT hyperedge_id, pos, vertex_id FROM inc JOIN cost USING (hyperedge_id) WHERE cost <= 15000000",
    remove_vertices: _NAT + f"SELECT hyperedge_id, {_RENUMBER.format(order='i.pos')}, vertex_id FROM inc i WHERE vertex_id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    remove_hyperedge: _INC + f"SELECT hyperedge_id, pos, vertex_id FROM inc WHERE hyperedge_id NOT IN ({_LIST})",
    remove_vertex: _NAT + f"SELECT hyperedge_id, {_RENUMBER.format(order='i.pos')}, vertex_id FROM inc i WHERE vertex_id <> {NATION}",
    contract_vertices: _NAT + f""", t AS (SELECT *, bool_or(vertex_id IN ({NATION}, {TO_NATION}, 11)) OVER (PARTITION BY hyperedge_id) AS hit,
        CASE WHEN vertex_id IN ({NATION}, {TO_NATION}, 11) THEN {NATION} ELSE vertex_id END AS v FROM inc),
        u AS (SELECT *, lag(v) OVER (PARTITION BY hyperedge_id ORDER BY pos) AS before FROM t)
        SELECT hyperedge_id, {_RENUMBER.format(order='u.pos')}, v AS vertex_id FROM u WHERE NOT hit OR before IS NULL OR before <> v""",
    join_hyperedges: _INC + f""", spot AS (SELECT * FROM (VALUES ({ORDERS[2]}, 0), ({ORDERS[1]}, 1), ({ORDERS[0]}, 2)) s(hyperedge_id, spot))
        SELECT hyperedge_id, pos, vertex_id FROM inc WHERE hyperedge_id NOT IN ({_LIST})
        UNION ALL SELECT {ORDERS[2]}, CAST(row_number() OVER (ORDER BY spot, pos) - 1 AS BIGINT), vertex_id FROM inc JOIN spot USING (hyperedge_id)""",
    shortest_distances: _NAT + f""", best AS (SELECT src, dst, min(cost) AS cost FROM lk WHERE src <> dst GROUP BY 1, 2),
        r(v, d, h) AS (SELECT CAST({NATION} AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
          UNION ALL SELECT dst, min(d + cost), h + 1 FROM r JOIN best ON src = v WHERE h < 24 GROUP BY dst, h)
        SELECT v AS vertex_id, b.d AS distance, b.h AS hops FROM (SELECT v, min(struct_pack(d := d, h := h)) AS b FROM r GROUP BY v)""",
    shortest_path: _NAT + f""", best AS (SELECT src, dst, min(struct_pack(cost := cost, e := hyperedge_id)) AS b FROM lk WHERE src <> dst GROUP BY 1, 2),
        r(v, d, h) AS (SELECT CAST({NATION} AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
          UNION ALL SELECT dst, min(d + b.cost), h + 1 FROM r JOIN best ON src = v WHERE h < 24 GROUP BY dst, h),
        lab AS (SELECT v, min(struct_pack(d := d, h := h)) AS b FROM r GROUP BY v),
        pre AS (SELECT y.v, y.b.h AS h, min(struct_pack(p := x.v, e := k.b.e)) AS m FROM lab x JOIN best k ON k.src = x.v JOIN lab y ON y.v = k.dst
                WHERE x.b.d + k.b.cost = y.b.d AND x.b.h + 1 = y.b.h GROUP BY 1, 2),
        back(v, e, h) AS (SELECT v, m.e, h FROM pre WHERE v = {TO_NATION} UNION ALL
                SELECT pre.v, pre.m.e, pre.h FROM back JOIN pre nxt ON nxt.v = back.v JOIN pre ON pre.v = nxt.m.p)
        SELECT h AS step, v AS vertex_id, e AS via_hyperedge_id FROM back UNION ALL SELECT 0, {NATION}, NULL WHERE EXISTS (SELECT 1 FROM back)""",
    weight_violations: "SELECT 'vertex' AS kind, p_name, count(*) AS n FROM part GROUP BY 2 HAVING count(*) > 1",
}


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _SQL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _SQL.items()}
