"""Corpus pipeline: stages applied in order, each on all rows that its predecessor kept.

Each stage is written as Parquet under ``spark.checkpoint.dir`` and read again as the next
one's documents. All but the last return the columns of ``documents``. A decision names a row by its id, which may be null, and
its text, so rows that share an id are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.llm import decontam, exact, packing, quality, simhash
from braid.llm.common import hit_bits, one_space, settle, table, text_hash_of, with_hits, without_hits


def _without(docs: DataFrame, gone: DataFrame, mark: str = "text_hash", own: Column | None = None) -> DataFrame:
    """The rows of ``docs`` whose id and text are not among ``gone(doc_id, mark)``; ``own`` makes the mark of a text.

    A bitmap of fixed size passes most rows on as they are; the others meet ``gone`` in a shuffle, however small it is.
    """
    gone = settle(gone.select(F.col("doc_id").alias("__doc"), F.col(mark).alias("__mark")).distinct(), "gone")  # as a table, so that AQE can split a hot key's join
    names = docs.columns
    docs = docs.withColumn("__id", F.col("doc_id").cast("bigint"))
    bitmap = settle(hit_bits(gone, "__doc"), "gone-bits")
    clear, met = (f(docs, "__id", bitmap).select("__id", *names) for f in (without_hits, with_hits))
    same = met["__id"].eqNullSafe(gone["__doc"]) & ((text_hash_of(met["text"]) if own is None else own) == gone["__mark"])
    met = met.join(gone.withColumn("__gone", F.lit(True)).hint("merge"), same, "left").where("__gone IS NULL")  # an anti-join would be pushed below the bitmap
    return clear.unionByName(met.select(clear.columns)).drop("__id")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return _without(docs, quality.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 0"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id, null last; of repeated rows of it, one."""
    sha = F.sha2(one_space(F.col("text")), 256)
    found = settle(exact.dedup_exact(docs), "exact")
    left = _without(docs, found.where("NOT doc_id <=> keep_id"), "text_sha256", sha)
    again = found.where("doc_id <=> keep_id AND NOT kept").select("doc_id", "text_sha256").distinct()
    if again.isEmpty():
        return left
    whole = _without(left, again, "text_sha256", sha)
    again = again.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    same = left.withColumn("__text", F.sha2(one_space(F.col("text")), 256))
    same = same.join(again, same["doc_id"].cast("bigint").eqNullSafe(again["__id"]) & (same["__text"] == again["__sha"]), "left_semi")
    return whole.unionByName(same.dropDuplicates(["doc_id", "__text"]).drop("__text"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest id; rows without an id go if another row has one."""
    return _without(docs, simhash.near_duplicates(docs).where("NOT doc_id <=> component_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontam.leaks(docs, table(spark, sf_dir, "benchmark")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their places in the sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, the fingerprints, the edit matching and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
