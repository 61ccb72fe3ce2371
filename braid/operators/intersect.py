"""Vertices that several hyperedges share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intersection(hyperedges: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """vertex_id held by every hyperedge in ``wanted``; repeats in it count once.

    The id filter reaches the scan; only vertices of the wanted rows are counted.
    """
    distinct = sorted(set(wanted))
    rows = hyperedges.where(F.col("hyperedge_id").isin(distinct)).select(F.explode(F.array_distinct("vertices")).alias("vertex_id"))
    return rows.groupBy("vertex_id").agg(F.count("*").alias("n")).where(F.col("n") == len(distinct)).select("vertex_id")
