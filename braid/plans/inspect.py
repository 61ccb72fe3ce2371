"""Reading physical plans in tests and while tuning."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df: DataFrame) -> Counter[str]:
    """How often each operator occurs in the plan."""
    return Counter(re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", physical(df), re.M))


def shuffles(df: DataFrame) -> int:
    return nodes(df)["Exchange"]


def read_columns(df: DataFrame) -> list[str]:
    """Columns that the scans read."""
    return sorted({c for s in re.findall(r"ReadSchema: struct<([^\n]*)>", physical(df)) for c in re.findall(r"(\w+):", s)})
