"""Mutations as projections of the hyperedge and vertex tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import contracted, ids, without


def replace(table: DataFrame, key: str, value: int, **columns: Column) -> DataFrame:
    """``columns`` changed on the one row whose ``key`` is ``value``."""
    here = F.col(key) == value
    changed = {c: F.when(here, new).otherwise(F.col(c)) for c, new in columns.items()}
    return table.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in table.columns])


def set_vertices(hyperedges: DataFrame, hyperedge: int, vertices: Sequence[int]) -> DataFrame:
    return replace(hyperedges, "hyperedge_id", hyperedge, vertices=ids(vertices))


def reverse_one(hyperedges: DataFrame, hyperedge: int) -> DataFrame:
    return replace(hyperedges, "hyperedge_id", hyperedge, vertices=F.reverse("vertices"))


def drop_hyperedges(hyperedges: DataFrame, gone: Sequence[int]) -> DataFrame:
    return hyperedges.where(~F.col("hyperedge_id").isin(list(gone)))


def drop_vertices(hyperedges: DataFrame, gone: Sequence[int]) -> DataFrame:
    """All occurrences of ``gone`` taken out; hyperedges left empty go."""
    stripped = hyperedges.withColumn("vertices", without(F.col("vertices"), gone))
    return stripped.where(F.size("vertices") > 0)


def drop_listed(hyperedges: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the hyperedges whose id is in ``gone(hyperedge_id)``, however many these are."""
    return hyperedges.join(gone.select("hyperedge_id"), "hyperedge_id", "left_anti").select(hyperedges.columns)


def reverse_listed(hyperedges: DataFrame, turned: DataFrame) -> DataFrame:
    """The hyperedges in ``turned(hyperedge_id)`` reversed."""
    marked = hyperedges.join(turned.select("hyperedge_id").distinct().withColumn("__turned", F.lit(True)), "hyperedge_id", "left")
    vertices = F.when(F.col("__turned"), F.reverse("vertices")).otherwise(F.col("vertices"))
    return marked.withColumn("vertices", vertices).select(hyperedges.columns)


def drop_listed_vertices(hyperedges: DataFrame, gone: DataFrame) -> DataFrame:
    """All occurrences of the vertices in ``gone(vertex_id)`` taken out; hyperedges left empty go.

    Only hyperedges that hold one of them are taken apart and put together again.
    """
    listed = gone.select("vertex_id").distinct()
    members = hyperedges.select("hyperedge_id", F.posexplode("vertices").alias("pos", "vertex_id"))
    hit = members.join(listed, "vertex_id", "left_semi").select("hyperedge_id").distinct()
    left = members.join(hit, "hyperedge_id", "left_semi").join(listed, "vertex_id", "left_anti")
    rebuilt = left.groupBy("hyperedge_id").agg(F.array_sort(F.collect_list(F.struct("pos", "vertex_id"))).alias("m"))
    rebuilt = rebuilt.select("hyperedge_id", F.col("m.vertex_id").alias("vertices"))
    changed = hyperedges.drop("vertices").join(rebuilt, "hyperedge_id").select(hyperedges.columns)
    return hyperedges.join(hit, "hyperedge_id", "left_anti").select(hyperedges.columns).union(changed)


def contract(hyperedges: DataFrame, merged: Sequence[int], target: int) -> DataFrame:
    return hyperedges.withColumn("vertices", contracted(F.col("vertices"), merged, target))


def concatenate(hyperedges: DataFrame, order: Sequence[int]) -> DataFrame:
    """The sequences in ``order`` joined into its first hyperedge; the others go.

    Only the listed rows, whose number the caller states, are brought together.
    """
    spots = F.create_map(*[x for i, h in enumerate(order) for x in (F.lit(int(h)).cast("bigint"), F.lit(i))])
    listed = hyperedges.where(F.col("hyperedge_id").isin(list(order))).withColumn("spot", spots[F.col("hyperedge_id")])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("spot", "vertices"))), lambda x: x["vertices"])
    whole = listed.agg(F.flatten(parts).alias("whole")).scalar()
    kept = drop_hyperedges(hyperedges, order[1:])
    return replace(kept, "hyperedge_id", order[0], vertices=whole)
