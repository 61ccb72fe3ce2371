"""Links and degrees of hyperedges that arrive as a stream.

The link relation is a projection of each row, so it runs on a stream as it does on a table;
degrees are a running count by vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relations import links


def link_stream(hyperedges: DataFrame) -> DataFrame:
    """hyperedge_id, pos, src, dst, cost of every hyperedge that arrives; append mode."""
    return links(hyperedges)


def degree_stream(hyperedges: DataFrame, end: str = "src") -> DataFrame:
    """vertex_id, degree so far at ``end`` of the links; update or complete mode."""
    return links(hyperedges).groupBy(F.col(end).alias("vertex_id")).agg(F.count("*").alias("degree"))
