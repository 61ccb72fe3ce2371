"""Columns of the two tables and what their types must satisfy."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import InvalidWeight

VERTEX_ID, HYPEREDGE_ID, VERTICES, WEIGHT, COST = "vertex_id", "hyperedge_id", "vertices", "weight", "cost"


def vertex_schema(weight: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(VERTEX_ID, T.LongType(), False), T.StructField(WEIGHT, weight, False)])


def hyperedge_schema(weight: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(HYPEREDGE_ID, T.LongType(), False),
            T.StructField(VERTICES, T.ArrayType(T.LongType(), False), False),
            T.StructField(WEIGHT, weight, False),
            T.StructField(COST, T.LongType(), False),
        ]
    )


def check_weight_type(kind: T.DataType, path: str = WEIGHT) -> None:
    """Refuse types without total equality: floating point anywhere, and maps."""
    if isinstance(kind, (T.FloatType, T.DoubleType, T.MapType)):
        raise InvalidWeight(at=path, type=kind.simpleString())
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            check_weight_type(f.dataType, f"{path}.{f.name}")
    if isinstance(kind, T.ArrayType):
        check_weight_type(kind.elementType, f"{path}[]")
