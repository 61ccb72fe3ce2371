"""The derived relations that every read is built on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import holds


def incidence(hyperedges: DataFrame, vertex: int | None = None) -> DataFrame:
    """hyperedge_id, pos, vertex_id: every occurrence. No shuffle.

    A ``vertex`` filters whole sequences below the explode, where the scan can drop them.
    """
    rows = hyperedges if vertex is None else hyperedges.where(holds(F.col("vertices"), vertex))
    rows = rows.select("hyperedge_id", F.posexplode("vertices").alias("pos", "vertex_id"))
    return rows if vertex is None else rows.where(F.col("vertex_id") == vertex)


def links(hyperedges: DataFrame, src: int | None = None, dst: int | None = None) -> DataFrame:
    """hyperedge_id, pos, src, dst, cost: every consecutive pair. No shuffle.

    The second member comes from the same array, not from a window, so a sequence is never
    dealt out again. Fixed ends filter whole sequences below the explode.
    """
    rows = hyperedges
    for end in (src, dst):
        if end is not None:
            rows = rows.where(holds(F.col("vertices"), end))
    rows = rows.select("hyperedge_id", "cost", "vertices", F.posexplode("vertices").alias("pos", "src"))
    rows = rows.select("hyperedge_id", "pos", "src", F.get("vertices", F.col("pos") + 1).alias("dst"), "cost").where("dst is not null")
    if src is not None:
        rows = rows.where(F.col("src") == src)
    return rows if dst is None else rows.where(F.col("dst") == dst)


def memberships(hyperedges: DataFrame) -> DataFrame:
    """vertex_id, hyperedge_id: each hyperedge once for each vertex it holds.

    Repeats go inside the array, before rows exist, so no distinct is needed.
    """
    return hyperedges.select(F.explode(F.array_distinct("vertices")).alias("vertex_id"), "hyperedge_id")
