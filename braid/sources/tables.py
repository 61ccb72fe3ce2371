"""Graphs from long rows, and graphs as two Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def sequences(rows: DataFrame, key: str, member: str, order: Sequence[str]) -> DataFrame:
    """hyperedge_id, vertices: the members of each key in the given order, repeats kept. One shuffle."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(member).cast("bigint").alias("__member"))))
    grouped = rows.groupBy(F.col(key).cast("bigint").alias("hyperedge_id")).agg(ordered.alias("__members"))
    return grouped.select("hyperedge_id", F.col("__members.__member").alias("vertices"))


def from_long_rows(rows: DataFrame, key: str, member: str, order: Sequence[str], vertices: DataFrame, weights: DataFrame) -> Graph:
    """A graph of one hyperedge for each ``key`` of ``rows``.

    ``weights(hyperedge_id, weight, cost)`` names the hyperedges; keys without rows would be
    empty and are left out, as a hyperedge needs a vertex.
    """
    named = sequences(rows, key, member, order).join(weights, "hyperedge_id").select("hyperedge_id", "vertices", "weight", "cost")
    return Graph.of(vertices, named)


def write(graph: Graph, folder: str) -> None:
    graph.vertices.write.mode("overwrite").parquet(f"{folder}/vertices")
    graph.hyperedges.write.mode("overwrite").parquet(f"{folder}/hyperedges")


def read(spark: SparkSession, folder: str) -> Graph:
    return Graph.of(spark.read.parquet(f"{folder}/vertices"), spark.read.parquet(f"{folder}/hyperedges"))
