"""Best-fit packing planned on the length histogram.

Documents are encoded once into pieces of at most ``CAPACITY`` tokens. The plan sees only
how many pieces there are of each length, which is at most ``CAPACITY`` numbers for any corpus:
best-fit decreasing runs over counts, filling whole ranges of sequences at a time. Every
piece then takes the planned slot of its rank within its length. Ranks come from counts by
task, so a length that a third of all pieces share is never gathered in one place.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import library_on_path, per_text, settle
from .encode import crc, encoder, tokenizer_path

CAPACITY = 4096

PIECE = "task int, rank_in_task bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots by best-fit decreasing: (length, first rank, first sequence, pieces a sequence, offset).

    Ranks of a length from ``first rank`` on, up to the next row of that length, go to
    sequences from ``first sequence`` on, so many in each, laid end to end from ``offset``.
    Open sequences are kept as ranges with equal free space; a length splits at most two ranges.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # free space: ranges (first sequence, count)
    order: list[int] = []  # free spaces in use, ascending
    made = 0

    def put(space: int, first: int, count: int) -> None:
        if count and space:
            if space not in free:
                free[space] = []
                bisect.insort(order, space)
            free[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                space = order[at]
                first, count = free[space].pop()
                if not free[space]:
                    del free[space], order[at]
            else:
                space, first, count = capacity, made, -(-left // (capacity // length))
                made += count
            each = space // length
            whole = min(count, left // each)
            if whole:
                slots.append((length, rank, first, each, capacity - space))
                put(space - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < count and left:
                slots.append((length, rank, first + whole, left, capacity - space))
                put(space - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(space, first + whole, count - whole)
    return slots


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its task and its rank among the pieces of its length in that task."""

    def make() -> Callable[[list, list], Iterator[tuple]]:
        encode, ranks = encoder(path).encode_ended, [0] * (capacity + 1)
        task = TaskContext.get().partitionId()

        def of(ids: list, texts: list) -> Iterator[tuple]:
            for doc_id, text in zip(ids, texts):
                tokens = encode(text)
                for k, start in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[start : start + capacity]
                    yield task, ranks[len(part)], doc_id, k, start, len(part), crc(part)
                    ranks[len(part)] += 1

        return of

    return per_text(docs, id_col, text_col, make, PIECE)


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    A null or empty text is the end id alone. Documents of more than ``capacity`` tokens are
    cut; no other is. Repeated rows, null ids and ties are packed like any row. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    rows = settle(pieces(docs, path, id_col, text_col, capacity), "pieces")
    counts = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = settle(counts, "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = plan(histogram, capacity)
    by_length: dict[int, np.ndarray] = {}
    for s in slots:
        by_length.setdefault(s[0], []).append(s[1:])
    by_length = {k: np.array(v, np.int64) for k, v in by_length.items()}
    shared = spark.sparkContext.broadcast(by_length)
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    # as many offsets as tasks times lengths: they grow with the input, so they are never broadcast
    ranked = rows.join(offsets.hint("merge"), ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("rank_in_task")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                of, at = table[int(size)], np.flatnonzero(length == size)
                slot = of[np.searchsorted(of[:, 0], rank[at], side="right") - 1]
                within = rank[at] - slot[:, 0]
                sequence[at] = slot[:, 1] + within // slot[:, 2]
                offset[at] = slot[:, 3] + within % slot[:, 2] * size
            columns = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    with library_on_path(spark):
        return ranked.mapInArrow(place, placed)
