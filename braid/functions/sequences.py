"""Expressions on a column that holds an ordered vertex sequence. All stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ids(values: Sequence[int]) -> Column:
    """A literal array of ids; empty is fine."""
    return F.array(*[F.lit(int(v)).cast("bigint") for v in values]).cast("array<bigint>")


def holds(vertices: Column, vertex: int | Column) -> Column:
    return F.array_contains(vertices, vertex)


def without(vertices: Column, gone: Sequence[int]) -> Column:
    """Every occurrence of ``gone`` taken out, the rest in order with its repeats."""
    if len(gone) == 1:
        return F.array_remove(vertices, int(gone[0]))
    taken = ids(gone)
    return F.filter(vertices, lambda v: ~F.array_contains(taken, v))


def collapsed(vertices: Column) -> Column:
    """Consecutive repeats as one."""
    return F.filter(vertices, lambda v, i: (i == 0) | (v != F.get(vertices, i - 1)))


def contracted(vertices: Column, merged: Sequence[int], target: int) -> Column:
    """``merged`` replaced by ``target`` and consecutive repeats collapsed, if any is held."""
    taken, to = ids(merged), F.lit(int(target)).cast("bigint")
    mapped = F.transform(vertices, lambda v: F.when(F.array_contains(taken, v), to).otherwise(v))
    return F.when(F.arrays_overlap(vertices, taken), collapsed(mapped)).otherwise(vertices)
