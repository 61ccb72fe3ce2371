"""Sorted-string-table shards of token ids, keyed by document id.

A shard file is: data blocks | block index | Bloom filter | footer. A block holds entries in
key order with the part of a key that it shares with the previous one left out, and is
compressed by itself. The index has the last key and place of each block, so a lookup reads the
footer, asks the filter, searches the index by halves and reads one run of blocks.

    entry   varint shared, varint unshared, varint value bytes, key suffix, value
    value   token ids as little-endian integers of ``width`` bytes
    index   for each block: key length (1 byte), last key, then offset and size (8 + 4 bytes)
    footer  index offset, index size, filter offset, filter size, documents, tokens
            (6 x 8 bytes), id width (1 byte), magic (7 bytes)

Keys are one byte 1 and the id's 8 bytes, big-endian with the sign bit turned, so byte order is
id order; a null id is the single byte 0 and comes first.

Scale: documents are range-partitioned by (id, hash of the text, row tag), so that even one id
with a third of all rows is split; each task streams blocks to shards of bounded size under a
name of its own attempt, and only names in the committed manifest count. The driver sees
one small row for each shard.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import library_on_path, per_text, scratch_path, settle
from .encode import crc, encoder, tokenizer_path

BLOCK_BYTES = 1 << 16
SHARD_BYTES = 1 << 26
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"BRDSST1"
_FOOTER = struct.Struct("<6QB7s")

MANIFEST = "task int, shard int, file string, docs bigint, tokens bigint, bytes bigint"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> Iterator[int]:
    h = xxhash.xxh64_intdigest(key)
    step = h >> 32 | 1
    return ((h + i * step) % bits for i in range(BLOOM_HASHES))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; keys must come in order."""

    def __init__(self, sink: pa.NativeFile, width: int = 2):
        self.sink, self.width = sink, width
        self.block, self.index, self.keys = bytearray(), bytearray(), []
        self.last, self.at, self.docs, self.tokens = b"", 0, 0, 0
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.docs and key < self.last:
            raise ValueError("keys out of order")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        if self.width == 2 and len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError("ids need a width of 4")
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(xxhash.xxh64_intdigest(key))
        self.docs += 1
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            packed = self.packer.compress(bytes(self.block))
            self.index += bytes([len(self.last)]) + self.last + struct.pack("<QI", self.at, len(packed))
            self.sink.write(packed)
            self.at += len(packed)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index_at, bits = self.at, max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        h = np.array(self.keys, np.uint64)
        for i in range(BLOOM_HASHES):
            places = [(int(x) + i * (int(x) >> 32 | 1)) % bits for x in h]
            bloom[places] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.sink.write(bytes(self.index) + packed)
        footer = (index_at, len(self.index), index_at + len(self.index), len(packed), self.docs, self.tokens, self.width, MAGIC)
        self.sink.write(_FOOTER.pack(*footer))
        self.sink.close()


class Shard:
    """Reads one shard from a seekable file: a scan in key order, or lookups."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        index_at, index_size, bloom_at, bloom_size, self.docs, self.tokens, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom = self._read(bloom_at, bloom_size)
        self.bits = max(64, BLOOM_BITS * self.docs)
        self.last_keys, self.places, at, index = [], [], 0, self._read(index_at, index_size)
        while at < len(index):
            n = index[at]
            self.last_keys.append(index[at + 1 : at + 1 + n])
            self.places.append(struct.unpack_from("<QI", index, at + 1 + n))
            at += 13 + n

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = zstandard.ZstdDecompressor().decompress(self._read(*self.places[block])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.places)):
            yield from self._entries(block)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document under ``doc_id``."""
        key, found = key_of(doc_id), []
        if not self.may_hold(key):
            return found
        for block in range(bisect_left(self.last_keys, key), len(self.places)):
            for k, ids in self._entries(block):
                if k > key:
                    return found
                if k == key:
                    found.append(ids)
        return found


def write_shards(docs: DataFrame, folder: str | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode and write all rows of ``docs``; returns the manifest, one row for each shard.

    Shards in the order of (task, shard) hold ascending ids, null ids first; rows with equal
    ids follow the hash of their text, then the order in which they were read.
    """
    spark = docs.sparkSession
    folder, path = folder or scratch_path(spark, "shards"), path or tokenizer_path()
    ordered = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(text_col).alias("by_text"), F.monotonically_increasing_id().alias("by_row"),
    )
    order = ["id", "by_text", "by_row"]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)

    def make() -> Callable[[list, list], Iterator[tuple]]:
        encode, task = encoder(path).encode_ended, TaskContext.get().partitionId()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        state: dict = {"n": 0, "writer": None, "file": None}

        def closed() -> tuple:
            w = state["writer"]
            w.close()
            state["writer"] = None
            state["n"] += 1
            return task, state["n"] - 1, state["file"], w.docs, w.tokens, w.at

        def of(ids: list, texts: list) -> Iterator[tuple]:
            for doc_id, text in zip(ids, texts):
                if state["writer"] is None:
                    state["file"] = f"{task:08d}-{state['n']:05d}-{uuid.uuid4().hex}.sst"
                    state["writer"] = ShardWriter(fs.open_output_stream(f"{base}/{state['file']}"))
                state["writer"].add(key_of(doc_id), encode(text))
                if state["writer"].at >= shard_bytes:
                    yield closed()

        of.finish = lambda: [closed()] if state["writer"] else []
        return of

    return settle(per_text(ordered, "id", "text", make, MANIFEST).withColumn("folder", F.lit(folder)), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards.

    ``start`` counts the ids of all documents before it in file order.
    """
    spark = manifest.sparkSession
    shards = manifest.orderBy("task", "shard").collect()  # one small row for each shard file
    before = [0, *accumulate(r["tokens"] for r in shards)]
    work = [(i, f"{r['folder']}/{r['file']}", before[i]) for i, r in enumerate(shards)]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not work:
        return spark.createDataFrame([], schema)
    frame = spark.createDataFrame(work, "shard int, file string, base bigint").repartitionByRange(len(work), "shard")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                fs, at = filesystem(name)
                keys, sizes, sums = [], [], []
                with fs.open_input_file(at) as source:
                    for key, ids in Shard(source).scan():
                        keys.append(id_of(key))
                        sizes.append(len(ids))
                        sums.append(crc(ids))
                n = np.array(sizes, np.int64)
                columns = [pa.array(keys, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    with library_on_path(frame.sparkSession):
        return frame.mapInArrow(scan, schema)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` as shards and read them back.

    Null and empty texts hold the end id alone. Repeated rows and equal ids are all kept,
    null ids come first, an empty table gives an empty result, other columns are ignored.
    """
    return read_shards(write_shards(docs, **options))
