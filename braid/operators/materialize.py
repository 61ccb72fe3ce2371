"""The full scan: weights of hyperedges with the weights of their vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_form(vertices: DataFrame, hyperedges: DataFrame) -> DataFrame:
    """hyperedge_id, pos, weight, vertex_weight: one row for each occurrence. One join; the weight travels with the sequence."""
    rows = hyperedges.select("hyperedge_id", "weight", F.posexplode("vertices").alias("pos", "vertex_id"))
    named = vertices.select("vertex_id", F.col("weight").alias("vertex_weight"))
    return rows.join(named, "vertex_id").select("hyperedge_id", "pos", "weight", "vertex_weight")


def materialize(vertices: DataFrame, hyperedges: DataFrame) -> DataFrame:
    """hyperedge_id, weight, vertex_weights in sequence order with repeats. One join and one aggregation."""
    members = F.array_sort(F.collect_list(F.struct("pos", "vertex_weight")))
    rows = long_form(vertices, hyperedges).groupBy("hyperedge_id").agg(F.any_value("weight").alias("weight"), members.alias("members"))
    return rows.select("hyperedge_id", "weight", F.col("members.vertex_weight").alias("vertex_weights"))
