"""Ids for many new rows at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import cut


def numbered(rows: DataFrame, order: Sequence[str | Column], start: int, name: str) -> DataFrame:
    """``rows`` with dense ids from ``start`` in the given order.

    A global row_number would put all rows in one task. Here rows are range-partitioned,
    numbered within their partition, and shifted by the sizes of the partitions before.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = cut(rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = spread.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    joined = spread.withColumn("__part", part).join(offsets, "__part")
    return joined.withColumn(name, place + F.col("__before") + start).drop("__at", "__part", "__before")
