"""Cheapest paths by label correction on DataFrames.

A label is (distance, hops, predecessor, hyperedge), compared in that order: ties go to fewer
hops, then the smaller predecessor, then the smaller hyperedge. Each round relaxes the
links that leave the vertices whose (distance, hops) improved. Only the labels that a round improved are
written; labels of earlier rounds stay where they are and are looked up for the vertices that the round reached.
Parallel links collapse to their cheapest before the first round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: The most rows of a round that are broadcast; beyond, the join is left to Spark.
BROADCAST_ROWS = 100_000
#: Rounds after which the labels written so far become one table, so that plans stay small.
MERGE_AFTER = 16
#: The most labels that a path is rebuilt from on the driver; beyond, each hop is a lookup.
PATH_ROWS = 1_000_000

def cheapest_links(links: DataFrame) -> DataFrame:
    """src, dst, cost, hyperedge_id: the cheapest link of each ordered pair, ties to the smaller hyperedge."""
    best = links.where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("cost", "hyperedge_id")).alias("best"))
    return best.select("src", "dst", "best.cost", "best.hyperedge_id")


def distances(links: DataFrame, source: int, target: int | None = None) -> DataFrame:
    """vertex_id, distance, hops, pred, via: the label of every vertex that can be reached.

    With a ``target``, labels dearer than the best known way to it are not followed, as costs
    are 0 or more; only the target's label and those on its path are then final.
    """
    spark = links.sparkSession
    best = cut(cheapest_links(links))
    row = "vertex_id bigint, label struct<distance: bigint, hops: int, pred: bigint, via: bigint>, moved boolean"
    written = [spark.createDataFrame([(source, (0, 0, None, None), True)], row)]
    fresh, bound = written[0], None
    while True:
        frontier = fresh.where("moved").select(F.col("vertex_id").alias("src"), "label.distance", "label.hops")
        if bound is not None:
            frontier = frontier.where(F.col("distance") <= bound)
        n = frontier.limit(BROADCAST_ROWS + 1).count()
        if not n:
            break
        label = F.struct((F.col("distance") + F.col("cost")).alias("distance"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("pred"), F.col("hyperedge_id").alias("via"))
        reached = best.join(_small(frontier, n), "src").groupBy(F.col("dst").alias("vertex_id")).agg(F.min(label).alias("label"))
        reached = cut(reached)
        wanted = _small(reached.select("vertex_id"), reached.limit(BROADCAST_ROWS + 1).count())
        was = _labels(_all(written).join(wanted, "vertex_id", "left_semi")).withColumnRenamed("label", "was")
        moved = F.col("was").isNull() | (F.struct("label.distance", "label.hops") != F.struct("was.distance", "was.hops"))
        fresh = cut(reached.join(was, "vertex_id", "left").where("was is null or label < was").select("vertex_id", "label", moved.alias("moved")))
        written.append(fresh)
        if len(written) > MERGE_AFTER:
            written = [cut(_labels(_all(written)).withColumn("moved", F.lit(False)))]
        if target is not None:
            row = _labels(_all(written).where(F.col("vertex_id") == target)).select("label.distance").first()
            bound = row["distance"] if row else None
    return _labels(_all(written)).select("vertex_id", "label.*")


def _all(written: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, written)


def _labels(rows: DataFrame) -> DataFrame:
    """The best label of each vertex, which is the last one written."""
    return rows.groupBy("vertex_id").agg(F.min("label").alias("label"))


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def path(links: DataFrame, source: int, target: int) -> list[tuple[int, int | None]]:
    """(vertex, hyperedge that led to it) from ``source`` to ``target``; empty if there is no way.

    Rebuilt backwards over predecessors: from one read of the labels where they are at most ``PATH_ROWS``, else
    with one lookup for each hop of the answer.
    """
    if source == target:
        return [(source, None)]
    labels = cut(distances(links, source, target).select("vertex_id", "pred", "via"))
    known = None
    if labels.limit(PATH_ROWS + 1).count() <= PATH_ROWS:
        known = {r["vertex_id"]: r for r in labels.collect()}
    steps: list[tuple[int, int | None]] = []
    at: int | None = target
    while at is not None:
        row = labels.where(F.col("vertex_id") == at).first() if known is None else known.get(at)
        if row is None:
            return []
        steps.append((at, row["via"]))
        at = row["pred"]
    return steps[::-1]
