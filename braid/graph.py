"""The graph handle: two DataFrames and the next free ids. Every mutator returns a new handle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import errors as E
from .operators import adjacency, edit, intersect, materialize, paths, relations
from .plans.lineage import cut
from .schema import check_weight_type, hyperedge_schema, vertex_schema

#: Mutations after which lineage is cut, so that plans of long scripts stay small.
CUT_AFTER = 10


@dataclass(frozen=True)
class Graph:
    """Directed relations among any number of vertices, in order and with repeats.

    ``vertices(vertex_id, weight)`` and ``hyperedges(hyperedge_id, vertices, weight, cost)``.
    Point methods check their arguments with small probes and raise; bulk methods return a
    DataFrame for all vertices or hyperedges and check nothing.
    """

    vertices: DataFrame
    hyperedges: DataFrame
    next_vertex_id: int
    next_hyperedge_id: int
    depth: int = 0

    # -- construction -------------------------------------------------------------------

    @classmethod
    def new(cls, spark: SparkSession, vertex_weight: T.DataType, hyperedge_weight: T.DataType, vertices: int = 0, hyperedges: int = 0) -> Graph:
        """An empty graph; the two capacities are hints and change nothing."""
        check_weight_type(vertex_weight)
        check_weight_type(hyperedge_weight)
        return cls(spark.createDataFrame([], vertex_schema(vertex_weight)), spark.createDataFrame([], hyperedge_schema(hyperedge_weight)), 0, 0)

    @classmethod
    def of(cls, vertices: DataFrame, hyperedges: DataFrame) -> Graph:
        """A graph over existing tables; ids go on after the largest ones.

        The rows are taken as they are: ``weight_violations`` finds weights that repeat.
        """
        check_weight_type(vertices.schema["weight"].dataType)
        check_weight_type(hyperedges.schema["weight"].dataType)
        v = vertices.agg(F.coalesce(F.max("vertex_id") + 1, F.lit(0))).first()[0]
        h = hyperedges.agg(F.coalesce(F.max("hyperedge_id") + 1, F.lit(0))).first()[0]
        return cls(vertices, hyperedges, v, h)

    def _next(self, **changes: Any) -> Graph:
        graph = replace(self, **changes, depth=self.depth + 1)
        if graph.depth >= CUT_AFTER:
            graph = replace(graph, vertices=cut(graph.vertices), hyperedges=cut(graph.hyperedges), depth=0)
        return graph

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    def clear(self) -> Graph:
        """No vertices, no hyperedges, ids from 0 again."""
        return Graph(self.vertices.limit(0), self.hyperedges.limit(0), 0, 0)

    def clear_hyperedges(self) -> Graph:
        """No hyperedges and their ids from 0 again; vertices stay."""
        return replace(self, hyperedges=self.hyperedges.limit(0), next_hyperedge_id=0)

    def __repr__(self) -> str:
        return f"Graph(vertices={self.vertices!r}, hyperedges={self.hyperedges!r}, ...)"

    # -- relations ----------------------------------------------------------------------

    def incidence(self, vertex: int | None = None) -> DataFrame:
        return relations.incidence(self.hyperedges, vertex)

    def links(self, src: int | None = None, dst: int | None = None) -> DataFrame:
        return relations.links(self.hyperedges, src, dst)

    def memberships(self) -> DataFrame:
        return relations.memberships(self.hyperedges)

    def adjacency_from(self) -> DataFrame:
        return adjacency.neighbours(self.links(), "src", "dst")

    def adjacency_to(self) -> DataFrame:
        return adjacency.neighbours(self.links(), "dst", "src")

    def full_adjacency_from(self) -> DataFrame:
        return adjacency.full_links(self.links(), "src", "dst")

    def full_adjacency_to(self) -> DataFrame:
        return adjacency.full_links(self.links(), "dst", "src")

    def degrees_in(self) -> DataFrame:
        return adjacency.degrees(self.vertices, self.links(), "dst")

    def degrees_out(self) -> DataFrame:
        return adjacency.degrees(self.vertices, self.links(), "src")

    def materialized(self) -> DataFrame:
        return materialize.materialize(self.vertices, self.hyperedges)

    def distances(self, source: int) -> DataFrame:
        self._need_vertices([source])
        return paths.distances(self.links(), source)

    def weight_violations(self) -> DataFrame:
        """kind, weight (as text), n: weights that several vertices or hyperedges share."""

        def shared(rows: DataFrame, kind: str) -> DataFrame:
            counted = rows.groupBy("weight").agg(F.count("*").alias("n")).where("n > 1")
            return counted.select(F.lit(kind).alias("kind"), F.to_json(F.struct("weight")).alias("weight"), "n")

        return shared(self.vertices, "vertex").unionByName(shared(self.hyperedges, "hyperedge"))

    # -- probes -------------------------------------------------------------------------

    def _vertex(self, vertex: int) -> Row:
        row = self.vertices.where(F.col("vertex_id") == vertex).first()
        if row is None:
            raise E.VertexNotFound(vertex=vertex)
        return row

    def _hyperedge(self, hyperedge: int) -> Row:
        row = self.hyperedges.where(F.col("hyperedge_id") == hyperedge).first()
        if row is None:
            raise E.HyperedgeNotFound(hyperedge=hyperedge)
        return row

    def _need_vertices(self, wanted: Sequence[int]) -> None:
        """Raise for the first of the caller's ids, in their order, that no vertex has."""
        found = {r[0] for r in self.vertices.where(F.col("vertex_id").isin(sorted(set(wanted)))).select("vertex_id").collect()}
        for v in wanted:
            if v not in found:
                raise E.VertexNotFound(vertex=v)

    def _need_hyperedges(self, wanted: Sequence[int]) -> None:
        found = {r[0] for r in self.hyperedges.where(F.col("hyperedge_id").isin(sorted(set(wanted)))).select("hyperedge_id").collect()}
        for h in wanted:
            if h not in found:
                raise E.HyperedgeNotFound(hyperedge=h)

    def _one(self, table: DataFrame, weight: Any) -> DataFrame:
        return self.spark.createDataFrame([(weight,)], T.StructType([table.schema["weight"]]))

    def _taken(self, table: DataFrame, weight: Any) -> bool:
        return not table.join(F.broadcast(self._one(table, weight)), "weight", "left_semi").limit(1).isEmpty()

    # -- point reads --------------------------------------------------------------------

    def count_vertices(self) -> int:
        return self.vertices.count()

    def count_hyperedges(self) -> int:
        return self.hyperedges.count()

    def vertex_weight(self, vertex: int) -> Any:
        return self._vertex(vertex)["weight"]

    def hyperedge_weight(self, hyperedge: int) -> Any:
        return self._hyperedge(hyperedge)["weight"]

    def hyperedge_vertices(self, hyperedge: int) -> list[int]:
        return list(self._hyperedge(hyperedge)["vertices"])

    def vertex_hyperedges(self, vertex: int) -> list[int]:
        """Ids of the hyperedges that hold the vertex, ascending."""
        self._need_vertices([vertex])
        rows = self.hyperedges.where(F.array_contains("vertices", vertex)).select("hyperedge_id").orderBy("hyperedge_id")
        return [r[0] for r in rows.collect()]

    def full_vertex_hyperedges(self, vertex: int) -> list[list[int]]:
        """The sequences of those hyperedges, one for each."""
        self._need_vertices([vertex])
        rows = self.hyperedges.where(F.array_contains("vertices", vertex)).orderBy("hyperedge_id").select("vertices")
        return [list(r[0]) for r in rows.collect()]

    def adjacent_from(self, vertex: int) -> list[int]:
        self._need_vertices([vertex])
        return [r[0] for r in self.links(src=vertex).select("dst").distinct().orderBy("dst").collect()]

    def adjacent_to(self, vertex: int) -> list[int]:
        self._need_vertices([vertex])
        return [r[0] for r in self.links(dst=vertex).select("src").distinct().orderBy("src").collect()]

    def full_adjacent_from(self, vertex: int) -> list[tuple[int, list[int]]]:
        self._need_vertices([vertex])
        rows = adjacency.full_neighbours(self.links(src=vertex), "src", "dst").orderBy("neighbour_id")
        return [(r["neighbour_id"], list(r["hyperedges"])) for r in rows.collect()]

    def full_adjacent_to(self, vertex: int) -> list[tuple[int, list[int]]]:
        self._need_vertices([vertex])
        rows = adjacency.full_neighbours(self.links(dst=vertex), "dst", "src").orderBy("neighbour_id")
        return [(r["neighbour_id"], list(r["hyperedges"])) for r in rows.collect()]

    def hyperedges_connecting(self, src: int, dst: int) -> list[int]:
        """One entry for each link from ``src`` to ``dst``; only ``src`` must exist."""
        self._need_vertices([src])
        return [r[0] for r in self.links(src, dst).select("hyperedge_id").orderBy("hyperedge_id").collect()]

    def degree_in(self, vertex: int) -> int:
        self._need_vertices([vertex])
        return self.links(dst=vertex).count()

    def degree_out(self, vertex: int) -> int:
        self._need_vertices([vertex])
        return self.links(src=vertex).count()

    def intersection(self, hyperedges: Sequence[int]) -> list[int]:
        """Vertices that all the hyperedges hold, ascending; an id may be given twice."""
        if len(hyperedges) < 2:
            raise E.TooFewToIntersect(hyperedges=list(hyperedges))
        self._need_hyperedges(hyperedges)
        return [r[0] for r in intersect.intersection(self.hyperedges, hyperedges).orderBy("vertex_id").collect()]

    def shortest_path(self, src: int, dst: int) -> list[tuple[int, int | None]]:
        self._need_vertices([src])
        self._need_vertices([dst])
        return paths.path(self.links(), src, dst)

    # -- mutations ----------------------------------------------------------------------

    def add_vertex(self, weight: Any) -> tuple[Graph, int]:
        new = self._one(self.vertices, weight)
        if self._taken(self.vertices, weight):
            raise E.VertexWeightTaken(weight=weight)
        row = new.select(F.lit(self.next_vertex_id).cast("bigint").alias("vertex_id"), "weight")
        return self._next(vertices=self.vertices.union(row), next_vertex_id=self.next_vertex_id + 1), self.next_vertex_id

    def add_vertices(self, weights: DataFrame, order: Sequence[str]) -> Graph:
        """All of ``weights(weight)``, with ids in the order of ``order``."""
        from .operators.ingest import numbered

        check_weight_type(weights.schema["weight"].dataType)
        weights = cut(weights)  # it is read several times
        if not weights.where("weight is null").isEmpty():
            raise E.InvalidWeight(weight=None)
        clash = weights.groupBy("weight").agg(F.count("*").alias("n")).where("n > 1").select("weight")
        clash = clash.union(weights.join(self.vertices, "weight", "left_semi").select("weight")).first()
        if clash is not None:
            raise E.VertexWeightTaken(weight=clash["weight"])
        rows = numbered(weights, order, self.next_vertex_id, "vertex_id").select("vertex_id", "weight")
        return self._next(vertices=self.vertices.union(rows), next_vertex_id=self.next_vertex_id + weights.count())

    def add_hyperedge(self, vertices: Sequence[int], weight: Any, cost: int) -> tuple[Graph, int]:
        if not vertices:
            raise E.NoVerticesToCreate(weight=weight)
        self._need_vertices(vertices)
        if cost is None or cost < 0:
            raise E.InvalidWeight(weight=weight, cost=cost)
        if self._taken(self.hyperedges, weight):
            raise E.HyperedgeWeightTaken(weight=weight)
        row = self.spark.createDataFrame([(self.next_hyperedge_id, list(vertices), weight, cost)], hyperedge_schema(self.hyperedges.schema["weight"].dataType))
        return self._next(hyperedges=self.hyperedges.union(row), next_hyperedge_id=self.next_hyperedge_id + 1), self.next_hyperedge_id

    def add_hyperedges(self, rows: DataFrame, order: Sequence[str]) -> Graph:
        """All of ``rows(vertices, weight, cost)``, checked in bulk, with ids in the order of ``order``."""
        from .operators.ingest import numbered

        check_weight_type(rows.schema["weight"].dataType)
        rows = cut(rows)  # it is read several times
        if (bad := rows.where("vertices is null or size(vertices) = 0").first()) is not None:
            raise E.NoVerticesToCreate(weight=bad["weight"])
        if (bad := rows.where("weight is null or cost is null or cost < 0").first()) is not None:
            raise E.InvalidWeight(weight=bad["weight"], cost=bad["cost"])
        unknown = rows.select(F.explode("vertices").alias("vertex_id")).join(self.vertices, "vertex_id", "left_anti").first()
        if unknown is not None:
            raise E.VertexNotFound(vertex=unknown[0])
        clash = rows.groupBy("weight").agg(F.count("*").alias("n")).where("n > 1").select("weight")
        clash = clash.union(rows.join(self.hyperedges, "weight", "left_semi").select("weight")).first()
        if clash is not None:
            raise E.HyperedgeWeightTaken(weight=clash["weight"])
        new = numbered(rows, order, self.next_hyperedge_id, "hyperedge_id").select("hyperedge_id", "vertices", "weight", "cost")
        return self._next(hyperedges=self.hyperedges.union(new), next_hyperedge_id=self.next_hyperedge_id + rows.count())

    def update_vertex_weight(self, vertex: int, weight: Any) -> Graph:
        old = self._vertex(vertex)
        new = self._one(self.vertices, weight)
        if old["weight"] == new.first()["weight"]:
            raise E.VertexWeightUnchanged(vertex=vertex, weight=weight)
        if self._taken(self.vertices, weight):
            raise E.VertexWeightTaken(weight=weight)
        return self._next(vertices=edit.replace(self.vertices, "vertex_id", vertex, weight=new.scalar()))

    def update_hyperedge_weight(self, hyperedge: int, weight: Any, cost: int) -> Graph:
        old = self._hyperedge(hyperedge)
        new = self._one(self.hyperedges, weight)
        if old["weight"] == new.first()["weight"]:
            raise E.HyperedgeWeightUnchanged(hyperedge=hyperedge, weight=weight)
        if self._taken(self.hyperedges, weight):
            raise E.HyperedgeWeightTaken(weight=weight)
        if cost is None or cost < 0:
            raise E.InvalidWeight(weight=weight, cost=cost)
        changed = edit.replace(self.hyperedges, "hyperedge_id", hyperedge, weight=new.scalar(), cost=F.lit(cost).cast("bigint"))
        return self._next(hyperedges=changed)

    def update_hyperedge_vertices(self, hyperedge: int, vertices: Sequence[int]) -> Graph:
        if not vertices:
            raise E.NoVerticesToUpdate(hyperedge=hyperedge)
        old = self._hyperedge(hyperedge)
        self._need_vertices(vertices)
        if list(old["vertices"]) == list(vertices):
            raise E.HyperedgeVerticesUnchanged(hyperedge=hyperedge)
        return self._next(hyperedges=edit.set_vertices(self.hyperedges, hyperedge, vertices))

    def reverse_hyperedge(self, hyperedge: int) -> Graph:
        old = list(self._hyperedge(hyperedge)["vertices"])
        if old == old[::-1]:
            raise E.HyperedgeVerticesUnchanged(hyperedge=hyperedge)
        return self._next(hyperedges=edit.reverse_one(self.hyperedges, hyperedge))

    def remove_hyperedge(self, hyperedge: int) -> Graph:
        self._need_hyperedges([hyperedge])
        return self._next(hyperedges=edit.drop_hyperedges(self.hyperedges, [hyperedge]))

    def remove_vertex(self, vertex: int) -> Graph:
        self._need_vertices([vertex])
        return self._next(vertices=self.vertices.where(F.col("vertex_id") != vertex), hyperedges=edit.drop_vertices(self.hyperedges, [vertex]))

    def remove_hyperedges(self, gone: DataFrame) -> Graph:
        """Without the hyperedges in ``gone(hyperedge_id)``; ids that no hyperedge has do nothing."""
        return self._next(hyperedges=edit.drop_listed(self.hyperedges, gone))

    def remove_vertices(self, gone: DataFrame) -> Graph:
        """Without the vertices in ``gone(vertex_id)``, everywhere; ids that no vertex has do nothing."""
        left = self.vertices.join(gone.select("vertex_id"), "vertex_id", "left_anti").select(self.vertices.columns)
        return self._next(vertices=left, hyperedges=edit.drop_listed_vertices(self.hyperedges, gone))

    def reverse_hyperedges(self, turned: DataFrame) -> Graph:
        """The hyperedges in ``turned(hyperedge_id)`` reversed; ids that no hyperedge has do nothing."""
        return self._next(hyperedges=edit.reverse_listed(self.hyperedges, turned))

    def contract(self, hyperedge: int, vertices: Sequence[int], target: int) -> tuple[Graph, list[int]]:
        """Merge ``vertices`` into ``target`` in every hyperedge; returns the given one's new sequence."""
        held = self.hyperedge_vertices(hyperedge)
        merged = sorted(set(vertices))
        if target not in merged:
            raise E.ContractionTargetMissing(hyperedge=hyperedge, target=target, vertices=merged)
        if missing := [v for v in merged if v not in held]:
            raise E.ContractionVerticesMissing(hyperedge=hyperedge, vertices=missing)
        graph = self._next(hyperedges=edit.contract(self.hyperedges, merged, target))
        return graph, graph.hyperedge_vertices(hyperedge)

    def join(self, hyperedges: Sequence[int]) -> Graph:
        """Concatenate the sequences, in the given order, into the first hyperedge."""
        if len(hyperedges) < 2:
            raise E.TooFewToJoin(hyperedges=list(hyperedges))
        if len(set(hyperedges)) < len(hyperedges):
            raise E.RepeatedInJoin(hyperedges=list(hyperedges))
        self._need_hyperedges(hyperedges)
        return self._next(hyperedges=edit.concatenate(self.hyperedges, hyperedges))
