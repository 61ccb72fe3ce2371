"""SimHash near-dedup with BK-trees.

Fingerprints are computed in Arrow batches. Equal fingerprints collapse to one node before
anything is compared. Two fingerprints within radius r agree on at least one of r+1 blocks
of bits. Nodes are dealt to shards by the first bits of each block, as many as make a shard of about ``TREE``
fingerprints, and each shard is a BK-tree: children keyed by their integer Hamming distance to the parent,
and a query follows only edges within the radius. So the trees do the search, and routing only picks the trees that can hold an
answer. A shard of more than ``SHARD`` fingerprints is dealt again by blocks of its remaining
bits, which stays exact and bounds every tree.

Trees of all fingerprints are not broadcast: they would grow with the corpus, and every query would
visit all of them. A tree reports a star (member, root) for each of its linked sets rather than all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, per_text, settle, slices, text_hash
from .components import connected_components

RADIUS, SHINGLE, SEED, BITS = 2, 3, 42, 64
#: Fingerprints that the trees are planned for, and the most in one tree; larger shards are dealt again.
TREE, SHARD = 512, 4096
#: Words hashed at a time in a long text.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        width = 1
    else:
        width = SHINGLE
    total, ones = len(words) - width + 1, np.zeros(BITS, np.int64)
    for at in range(0, total, CHUNK):
        part = words[at : min(at + CHUNK, total) + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(part) - width + 1
        of = xxhash.xxh64_intdigest
        hashes = np.array([of(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = n // 255 * 255
        ones += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), text_hash for each row."""

    def of(ids: list, texts: list) -> Iterator[tuple]:
        return zip(ids, (_signed(fingerprint(t)) for t in texts), map(text_hash, texts))

    return per_text(docs, id_col, text_col, lambda: of, "doc_id bigint, fp bigint, text_hash bigint")


class BKTree:
    """Fingerprints by Hamming distance: a child hangs at its distance to the parent."""

    def __init__(self) -> None:
        self.root: list | None = None

    def within(self, fp: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ fp).bit_count()
            if d <= radius:
                found.append(value)
            if len(children) <= 2 * radius:
                todo += [c for k, c in children.items() if -radius <= k - d <= radius]
            else:
                todo += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
        return found

    def add(self, fp: int) -> None:
        node = self.root
        if node is None:
            self.root = [fp, {}]
            return
        while d := (node[0] ^ fp).bit_count():
            if d not in node[1]:
                node[1][d] = [fp, {}]
                return
            node = node[1][d]


def linked_sets(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Stars (member, smallest member) of the sets that links within ``radius`` connect."""
    tree, parent = BKTree(), {v: v for v in values}

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for v in values:
        for near in tree.within(v, radius):
            a, b = find(v), find(near)
            parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, r) for v in values if (r := find(v)) != v]


def _split(mask: int, radius: int, width: int = BITS) -> list[int]:
    """The bits that ``mask`` leaves free, cut into radius + 1 blocks; the first ``width`` bits of each joined to ``mask``."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    cuts = np.array_split(free, radius + 1)
    return [mask | sum(1 << int(i) for i in cut[:width]) for cut in cuts if len(cut)]


def _width(nodes: int, tree: int) -> int:
    """Bits that deal ``nodes`` spread fingerprints into shards of about ``tree``."""
    return max(1, (nodes // max(1, tree)).bit_length())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(nodes: DataFrame, masks: list[int], radius: int, width: int) -> DataFrame:
    """fp with each block mask below its present mask, and its bits there."""
    below = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in _split(m, radius, width)]))])
    rows = nodes.select("fp", F.explode(below[F.col("mask")]).alias("mask"))
    if masks != [0]:  # the same bits can be fixed in another order
        rows = rows.distinct()
    return rows.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Stars ``a, b`` whose connected sets are those of all links between distinct ``fp``."""

    def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        stars = [s for fps in slices(batch.column(0)) for s in linked_sets(np.sort(fps).view(np.uint64).tolist(), radius)]
        a, b = np.array(stars, np.uint64).reshape(-1, 2).view(np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    masks, found, width = [0], None, _width(nodes.count(), min(TREE, shard))
    nodes = nodes.select("fp", F.lit(0).cast("bigint").alias("mask"))
    while True:
        keys = _dealt(nodes, masks, radius, width)
        masks, width = sorted({s for m in masks for s in _split(m, radius, width)}), BITS
        sizes = keys.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1")
        sizes = settle(sizes, "shard-sizes")  # as a table, so that AQE can split a hot shard's join
        keys = settle(keys.join(sizes, ["mask", "bits"]), "shards")
        cold = keys.where(F.col("n") <= shard).groupBy("mask", "bits").agg(F.collect_list("fp").alias("fps")).select("fps")
        stars = in_arrow(cold, search, "a bigint, b bigint")
        found = stars if found is None else found.union(stars)
        nodes = keys.where(F.col("n") > shard).select("fp", "mask")
        if all(len(_split(m, radius)) <= radius for m in masks) or nodes.isEmpty():
            return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id, text_hash for every row of ``docs``.

    Null and empty texts have the fingerprint zero, which is linked like any other. A row
    with a null id belongs to its component but never names it unless all ids there are
    null. Repeated rows stay. An empty table gives an empty result; other columns are ignored.
    """
    rows = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = connected_components(links(nodes, radius))
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    linked = joined.where("linked")
    names = settle(linked.groupBy("root").agg(F.min("least").alias("component_id")), "component-names")
    named = linked.join(names, "root").select("fp", "component_id").union(joined.where("NOT linked AND n > 1").select("fp", "least"))
    named = settle(named, "components")  # as a table, so that AQE can split a hot fingerprint's join
    return rows.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash"
    )
