"""Exact dedup: a log-structured merge index of digests. DataFrame functions only.

Write path: the rows of each task are dealt to memtables of at most ``MEMTABLE`` rows, and each is flushed as a
file of (digest, id, row tag, count), sorted by digest, with a Bloom filter and min/max statistics in its footer. The files
of one flush are a run of level 0. A level that holds ``FANOUT`` runs is compacted into one run of the
next level, and the runs it was made of are retired: the smallest identifier and the sum of the
counts stay for each digest, and every row counts in exactly one live run.

Read path: a lookup tests keys against the filter of each live run, a bitmap of fixed size made
when the run is written, and joins only the keys that pass with that run.

A digest whose count is over one is a hit; texts of hits are
compared byte by byte (smallest and largest text of a digest must be equal), and digests
that fail are grouped again by the text itself, so a collision never merges two texts.

Scale: the runs hold no text. Compaction pre-aggregates before its shuffle, so a group
with a third of all rows sends one row a task. Bytes are compared with a partial
minimum and maximum in each task, behind a bitmap of fixed size that keeps non-hits out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, forget, hit_bits, one_space, scratch_path, settle, with_hits

RUN_SCHEMA = "digest binary, id_null boolean, id bigint, tag bigint, n bigint"
#: The most rows of a memtable.
MEMTABLE = 1_000_000
#: Runs of a level that are compacted into one of the next.
FANOUT = 4


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass
class Run:
    """Sorted files of digests and the bitmap of those digests."""

    path: str
    filter: DataFrame


class DigestIndex:
    """Runs of digests in the shared folder; ``levels[k]`` lists the live runs of level k, oldest first."""

    def __init__(self, spark: SparkSession, digest: Callable[[Column], Column] = sha256_digest, memtable: int = MEMTABLE, fanout: int = FANOUT):
        self.spark, self.digest, self.memtable, self.fanout = spark, digest, memtable, fanout
        self.levels: list[list[Run]] = [[]]
        self.retired: list[Run] = []

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Write the memtables of ``docs`` as a run of level 0, compact full levels, and return the run's rows."""
        rows = docs.select(
            self.digest(one_space(F.col(text_col))).alias("digest"),
            F.col(id_col).isNull().alias("id_null"),
            F.col(id_col).cast("bigint").alias("id"),
            F.monotonically_increasing_id().alias("tag"),
            F.lit(1).cast("bigint").alias("n"),
        )
        run = self._write(rows, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1
        return self.read(run)

    def _write(self, rows: DataFrame, level: int) -> Run:
        path = scratch_path(self.spark, f"run-{level}")
        writer = rows.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true")
        writer.option("maxRecordsPerFile", self.memtable).parquet(path)
        digests = self.spark.read.schema(RUN_SCHEMA).parquet(path)
        run = Run(path, settle(hit_bits(digests, "digest"), "run-filter"))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        return run

    def read(self, *runs: Run) -> DataFrame:
        frames = [self.spark.read.schema(RUN_SCHEMA).parquet(r.path) for r in runs]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], RUN_SCHEMA)

    @property
    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def compact(self, level: int | None = None) -> DataFrame:
        """Merge the runs of ``level``, or of all levels, into one run below and return its rows.

        The merged runs are retired: nothing looks them up, and ``drop_retired`` deletes them.
        """
        merged = self.runs if level is None else list(self.levels[level])
        below = (len(self.levels) - 1 if level is None else level) + 1
        for k in range(len(self.levels)) if level is None else [level]:
            self.levels[k] = []
        run = self._write(merge(self.read(*merged), F.col("digest")), below)
        self.retired += merged
        return self.read(run)

    def drop_retired(self) -> None:
        """Delete the files of retired runs."""
        for run in self.retired:
            delete(self.spark, run.path)
            forget(run.filter)
        self.retired = []

    def lookup(self, keys: DataFrame) -> DataFrame:
        """digest, id_null, id, tag, n of the ``keys(digest)`` that the live runs hold: smallest identifier, summed count."""
        distinct = keys.select("digest").distinct()
        parts = [with_hits(distinct, "digest", run.filter).join(self.read(run), "digest") for run in self.runs]
        return merge(reduce(DataFrame.unionByName, parts) if parts else self.read(), F.col("digest"))


def merge(rows: DataFrame, *keys: Column) -> DataFrame:
    """One row for each key: the smallest (id, tag), nulls last, and the summed counts."""
    best = F.min(F.struct("id_null", "id", "tag")).alias("best")
    return rows.groupBy(*keys).agg(best, F.sum("n").alias("n")).select(*keys, "best.id_null", "best.id", "best.tag", "n")


def collisions(docs: DataFrame, compacted: DataFrame, digest: Callable[[Column], Column], text_col: str) -> DataFrame:
    """Digests that stand for more than one text, found on the bytes of all hits."""
    texts = docs.select(one_space(F.col(text_col)).alias("text")).withColumn("digest", digest(F.col("text")))
    hits = with_hits(texts, "digest", hit_bits(compacted.where("n > 1"), "digest"))
    return hits.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("digest")


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    Texts are equal when their normalised bytes are. Null text counts as empty. Of equal
    texts the row with the smallest id stays; null ids come last; of rows with equal ids
    and texts exactly one is kept. An empty table gives an empty result. Other columns of
    ``docs`` are ignored, whatever their names. ``text_sha256`` is null only if another
    ``digest`` is given (as tests do, to provoke collisions).
    """
    index = DigestIndex(docs.sparkSession, digest)
    run = index.flush(docs, id_col, text_col)
    compacted = index.compact()
    bad = settle(collisions(docs, compacted, digest, text_col), "collisions")
    resolved = _resolve(run, compacted.where("n > 1"), ["digest"])
    if not bad.isEmpty():
        rows = docs.select(
            one_space(F.col(text_col)).alias("text"),
            F.col(id_col).isNull().alias("id_null"),
            F.col(id_col).cast("bigint").alias("id"),
            F.monotonically_increasing_id().alias("tag"),
            F.lit(1).cast("bigint").alias("n"),
        ).withColumn("digest", digest(F.col("text")))
        rows = settle(rows.join(bad, "digest", "left_semi"), "collided")
        again = _resolve(rows, merge(rows, F.col("digest"), F.col("text")), ["digest", "text"])
        resolved = resolved.join(bad, "digest", "left_anti").unionByName(again)
    shown = F.lower(F.hex("digest")) if digest is sha256_digest else F.lit(None).cast("string")
    return resolved.select("doc_id", "keep_id", "group_size", "kept", shown.alias("text_sha256"))


def _resolve(run: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    best = groups.select(*keys, F.struct("id", "tag").alias("best"), F.col("n").alias("size"))
    return run.join(best, keys, "left").select(
        F.col("id").alias("doc_id"),
        F.coalesce("best.id", "id").alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("size").isNull() | (F.col("best.tag") == F.col("tag"))).alias("kept"),
        "digest",
    )
