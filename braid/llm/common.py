"""Shared-folder tables and small helpers for the training-data operators.

Everything that cuts lineage is written under ``spark.checkpoint.dir``, which the cluster
names and every executor can read. Only a session on one machine may do without that setting.
Tables lie in a folder of their application; operators delete those that no result reads
(``forget``), and ``release`` deletes the rest once results have been written elsewhere.
"""

from __future__ import annotations

import functools
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a Python function takes at a time: documents may be long. Spark bounds the bytes of a whole batch.
ARROW_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only for a session on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = _local_dir(spark.sparkContext.applicationId)
    return named.rstrip("/")


@functools.cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"braid-{application}-")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/braid/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.scratch)


def sweep(*tables: DataFrame) -> None:
    """``forget``, and have the driver collect garbage, on which Spark deletes the shuffle files of queries that nothing holds any more.

    Else they lie until the driver's heap fills, and every step's files add up. Only for operators of many large shuffles.
    """
    forget(*tables)
    SparkSession.active()._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete all tables of this application; results that were not written elsewhere go with them."""
    delete(spark, _own_dir(spark))


@contextmanager
def library_on_path(spark: SparkSession) -> Iterator[None]:
    """Functions that are made inside find this library in their Python workers."""
    env = spark.sparkContext.environment
    before = env.get("PYTHONPATH")
    if before is None:
        env["PYTHONPATH"] = str(Path(__file__).resolve().parents[2])
    try:
        yield
    finally:
        if before is None:
            del env["PYTHONPATH"]


def in_arrow(rows: DataFrame, run: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function of one batch of at most ``ARROW_ROWS`` rows. No setting of the session changes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ARROW_ROWS):
                yield from run(batch.slice(at, ARROW_ROWS))

    with library_on_path(rows.sparkSession):
        return rows.mapInArrow(each, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_space(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space.

    Plain replacements come first, as they are far cheaper than a regular expression, which
    only texts with two spaces in a row then need.
    """
    flat = F.coalesce(text, F.lit(""))
    for char in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(char), F.lit(" "))
    return F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat)


def text_hash(text: str | None) -> int:
    """XXH64 of a text with Spark's seed as a signed number: with the id it names a row's decision. Null counts as empty."""
    h = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def text_hash_of(text: Column) -> Column:
    """The same as a column."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def ends_of(column: pa.Array) -> list[int]:
    """Where the lists of an Arrow list column begin in its flat values, and the end."""
    at = column.offsets.to_numpy()
    return (at - at[0]).tolist()


def slices(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of an Arrow list column as NumPy views."""
    values, at = column.flatten().to_numpy(zero_copy_only=False), ends_of(column)
    return (values[a:b] for a, b in zip(at, at[1:]))


def per_text(docs: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list, list], Iterable[tuple]]], schema: str) -> DataFrame:
    """Rows that a Python function makes of Arrow batches of (ids, whole texts).

    ``make`` runs once a task and returns the function of a batch, which takes the ids (which may
    be null) and the texts as lists and yields rows in the order of ``schema``. If it has an
    attribute ``finish``, that is called after the last batch for the rows that are left.
    """
    shape = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        parts = (b.slice(at, ARROW_ROWS) for b in batches for at in range(0, b.num_rows, ARROW_ROWS))
        batched = (of(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in parts)
        for rows in itertools.chain(batched, (f() for f in [getattr(of, "finish", None)] if f)):
            if columns := list(zip(*rows)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    with library_on_path(docs.sparkSession):
        return rows.mapInArrow(run, schema)


#: Bits of a map of values that goes to all tasks: 2^17 words of 64 bits, whatever the input.
HIT_BITS = 1 << 23


def _word(value: str, bits: int) -> Column:
    # an expression that is never null: a join on it adds no filter that would compute it again
    return F.shiftright(F.xxhash64(value).bitwiseAND(F.lit(bits - 1).cast("bigint")), 6)


def _bit(value: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(xxhash64({value}) & 63L as int))")


def hit_bits(values: DataFrame, value: str, bits: int = HIT_BITS) -> DataFrame:
    """A bitmap of fixed size, as rows (__word, __bits), that has the bit of every value set."""
    return values.groupBy(_word(value, bits).alias("__word")).agg(F.bit_or(_bit(value)).alias("__bits"))


def with_hits(rows: DataFrame, value: str, bitmap: DataFrame, bits: int = HIT_BITS) -> DataFrame:
    """Rows whose value may be in the bitmap: all that are, and few others.

    Only this bounded table is broadcast. A full bitmap lets everything pass, which costs a
    larger shuffle afterwards and changes no result.
    """
    tested = rows.withColumn("__word", _word(value, bits)).join(F.broadcast(bitmap), "__word")
    return tested.where(F.col("__bits").bitwiseAND(_bit(value)) != 0).drop("__word", "__bits")


def without_hits(rows: DataFrame, value: str, bitmap: DataFrame, bits: int = HIT_BITS) -> DataFrame:
    """The rows that ``with_hits`` leaves out."""
    tested = rows.withColumn("__word", _word(value, bits)).join(F.broadcast(bitmap), "__word", "left")
    return tested.where(F.coalesce(F.col("__bits"), F.lit(0).cast("bigint")).bitwiseAND(_bit(value)) == 0).drop("__word", "__bits")
