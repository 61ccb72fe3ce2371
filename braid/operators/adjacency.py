"""Neighbours and degrees over the link relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def neighbours(links: DataFrame, near: str, far: str) -> DataFrame:
    """vertex_id, neighbour_id: distinct pairs of linked vertices, seen from the ``near`` end."""
    return links.select(F.col(near).alias("vertex_id"), F.col(far).alias("neighbour_id")).distinct()


def full_links(links: DataFrame, near: str, far: str) -> DataFrame:
    """vertex_id, neighbour_id, hyperedge_id, pos: a row for each link, seen from the ``near`` end. No shuffle, no lists."""
    return links.select(F.col(near).alias("vertex_id"), F.col(far).alias("neighbour_id"), "hyperedge_id", "pos")


def full_neighbours(links: DataFrame, near: str, far: str) -> DataFrame:
    """vertex_id, neighbour_id, hyperedges: one entry for each link, by (hyperedge, place). For links of one vertex."""
    crossed = F.array_sort(F.collect_list(F.struct("hyperedge_id", "pos")))
    grouped = links.groupBy(F.col(near).alias("vertex_id"), F.col(far).alias("neighbour_id")).agg(crossed.alias("crossed"))
    return grouped.select("vertex_id", "neighbour_id", F.col("crossed.hyperedge_id").alias("hyperedges"))


def degrees(vertices: DataFrame, links: DataFrame, end: str) -> DataFrame:
    """vertex_id, degree: links at ``end`` of each vertex, with multiplicity; 0 without any."""
    counted = links.groupBy(F.col(end).alias("vertex_id")).agg(F.count("*").alias("degree"))
    return vertices.select("vertex_id").join(counted, "vertex_id", "left").select("vertex_id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def pair_intersections(memberships: DataFrame) -> DataFrame:
    """a, b, vertex_id of neighbouring hyperedge ids (b = a + 1) that share a vertex: a co-located equi-join."""
    one = memberships.select(F.col("hyperedge_id").alias("a"), "vertex_id")
    two = memberships.select((F.col("hyperedge_id") - 1).alias("a"), "vertex_id")
    return one.join(two, ["a", "vertex_id"]).select("a", (F.col("a") + 1).alias("b"), "vertex_id")
