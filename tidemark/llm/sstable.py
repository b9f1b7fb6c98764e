"""Sorted-string-table shards of token ids.

Shard: blocks, sparse index, Bloom filter, footer. A record's key is its identifier as 8 big-endian bytes with the
sign bit flipped, so that byte order is number order; its value is its token ids as little-endian integers of 2 or 4
bytes. A block holds records in key order, each as (shared prefix length with the key before, rest of the key, number
of ids, place of its first id within the shard), then all values compressed together. The index has each block's
first key, offset and length. The footer has a fixed size and is read first: a lookup reads the footer, the filter,
the index (binary search), and one block.

Shards are written by the tasks of a range-partitioned, sorted table into one folder that executors share, each under
a temporary name and then renamed, so that a task that runs twice leaves one complete file. Null text: as empty, so one
end id. Rows with a null id have the empty key, which precedes all others, and read back with a null id. Repeated ids
stay as records of their own. Empty table: no shards. Columns besides id and text are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import encoder

MAGIC = b"TMSST002"
FOOTER = struct.Struct("<QQQQQQQB7x8s")  # index at, index bytes, filter at, filter bytes, hash count, records, ids, width, magic
BLOCK_BYTES = 256 * 1024
BITS_PER_KEY = 10


def key_of(ident: int | None) -> bytes:
    return b"" if ident is None else struct.pack(">Q", (int(ident) + (1 << 63)) & ((1 << 64) - 1))


def ident_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _hashes(key: bytes) -> tuple[int, int]:
    return zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1


def _probes(a: int, b: int, k: int, bits: int) -> list[int]:
    return [(a + i * b) % bits for i in range(k)]


class Writer:
    """Append records in ascending key order, then close; only one block is held in memory, besides the 8 bytes a key
    that the filter needs."""

    def __init__(self, sink, width: int, block_bytes: int = BLOCK_BYTES):
        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.at = self.ids = self.records = 0
        self.hashes, self.last, self.index = array("I"), None, []
        self._new()

    def _new(self):
        self.head, self.values, self.first, self.before, self.held, self.in_block = bytearray(), [], None, b"", 0, 0

    def add(self, ident: int, ids) -> None:
        key = key_of(ident)
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix([self.before, key]))
        self.first = key if self.first is None else self.first
        value = np.asarray(ids, dtype=f"<u{self.width}").tobytes()
        self.head += struct.pack("<BB", shared, len(key) - shared) + key[shared:] + struct.pack("<IQ", len(ids), self.ids)
        self.values.append(value)
        self.before, self.held, self.in_block = key, self.held + len(value), self.in_block + 1
        self.hashes.extend(_hashes(key))
        self.last = key
        self.ids += len(ids)
        self.records += 1
        if self.held >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.in_block:
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(self.values))
            block = struct.pack("<III", self.in_block, len(self.head), self.held) + bytes(self.head) + body
            self.index.append((self.first, self.at, len(block)))
            self.sink.write(block)
            self.at += len(block)
        self._new()

    def close(self) -> None:
        self._flush()
        k, bits = 7, max(64, -(-self.records * BITS_PER_KEY // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        for i in range(0, len(self.hashes), 2):
            bloom[_probes(self.hashes[i], self.hashes[i + 1], k, bits)] = 1
        bloom = np.packbits(bloom).tobytes()
        index = b"".join(struct.pack("<B8sQQ", len(key), key, at, n) for key, at, n in self.index)
        self.sink.write(bloom + index)
        self.sink.write(FOOTER.pack(self.at + len(bloom), len(index), self.at, len(bloom), k, self.records, self.ids, self.width, MAGIC))


class Reader:
    """Reads one shard from a seekable file."""

    def __init__(self, file):
        self.file = file
        file.seek(-FOOTER.size, 2)
        self.index_at, self.index_bytes, self.bloom_at, self.bloom_bytes, self.k, self.records, self.ids, self.width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard, or cut short")
        file.seek(self.index_at)
        raw = file.read(self.index_bytes)
        self.index = [(key[:n], at, size) for n, key, at, size in struct.iter_unpack("<B8sQQ", raw)]

    def _block(self, at: int, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
        self.file.seek(at)
        raw = self.file.read(n)
        count, head, held = struct.unpack_from("<III", raw)
        values = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[12 + head :], max_output_size=max(1, held)), f"<u{self.width}")
        p, key, v = 12, b"", 0
        for _ in range(count):
            shared, rest = struct.unpack_from("<BB", raw, p)
            key = key[:shared] + raw[p + 2 : p + 2 + rest]
            m, start = struct.unpack_from("<IQ", raw, p + 2 + rest)
            p += 2 + rest + 12
            yield ident_of(key), start, values[v : v + m]
            v += m

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for _, at, n in self.index:
            yield from self._block(at, n)

    def get(self, ident: int | None) -> list[np.ndarray]:
        """Ids of every record with this key: filter, binary search of the index, then the blocks that may hold it."""
        key = key_of(ident)
        self.file.seek(self.bloom_at)
        bloom = np.frombuffer(self.file.read(self.bloom_bytes), np.uint8)
        if any(not bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(*_hashes(key), self.k, len(bloom) * 8)):
            return []
        firsts = [x[0] for x in self.index]
        i = max(0, bisect_right(firsts, key) - 1)
        while i > 0 and firsts[i] == key:
            i -= 1
        found = []
        for first, at, n in self.index[i:]:
            if first > key:
                break
            found += [ids for x, _, ids in self._block(at, n) if x == ident]
        return found


def _opened(path: str, mode: str):
    """A file of the shared folder: a mounted path, or any store that pyarrow knows by its URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return open(path, mode)
    fs, inner = pa.fs.FileSystem.from_uri(path)
    return fs.open_output_stream(inner) if "w" in mode else fs.open_input_file(inner)


def _renamed(a: str, b: str) -> None:
    if a.startswith("file:"):
        a, b = "/" + a[5:].lstrip("/"), "/" + b[5:].lstrip("/")
    if a.startswith("/"):
        os.replace(a, b)
    else:
        fs, inner = pa.fs.FileSystem.from_uri(a)
        fs.move(inner, pa.fs.FileSystem.from_uri(b)[1])


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode every text, append end_id, write shards in ascending id order. Eager; returns one row per shard:
    shard (file), first_id, last_id, n_docs, n_ids."""
    spark = docs.sparkSession
    small_batches(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, name, out = encoder(tokenizer_path), f"shard-{TaskContext.get().partitionId():06d}.sst", None
        width = 2 if max(e.tokenizer.get_vocab_size(), end_id + 1) <= 65536 else 4
        temp = f"{folder}/_{name}.{TaskContext.get().taskAttemptId()}"
        first = last = None
        for b in frames:
            for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    file = _opened(temp, "wb")
                    out, first = Writer(file, width, block_bytes), ident
                ids = e.ids(text or "")
                ids.append(end_id)
                out.add(ident, ids)
                last = ident
        if out is not None:
            out.close()
            file.close()
            _renamed(temp, f"{folder}/{name}")
            ends = [pa.array([x], pa.int64()) for x in (first, last, out.records, out.ids)]
            yield pa.RecordBatch.from_arrays([pa.array([name]), *ends], ["shard", "first_id", "last_id", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")  # nulls first
    made = rows.mapInArrow(run, "shard string, first_id long, last_id long, n_docs long, n_ids long")
    made.write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def read_shards(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Every record of every shard, from the files: id, shard, place (ids before it in its shard), ids array<int>."""
    manifest = spark.read.parquet(f"{folder}/_manifest")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for shard in b.column(0).to_pylist():
                with _opened(f"{folder}/{shard}", "rb") as file:
                    held = []
                    for ident, start, ids in Reader(file):
                        held.append((ident, shard, start, ids.astype(np.int32)))
                        if len(held) == 256:
                            yield _batch(held, id_col)
                            held = []
                    if held:
                        yield _batch(held, id_col)

    return manifest.select("shard").repartition(max(1, manifest.count()), "shard").mapInArrow(run, f"{id_col} long, shard string, place long, ids array<int>")


def _batch(rows: list, id_col: str) -> pa.RecordBatch:
    ident, shard, start, ids = zip(*rows, strict=True)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(ident, pa.int64()), pa.array(shard), pa.array(start, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], [id_col, "shard", "place", "ids"])


def shard_starts(manifest: DataFrame) -> DataFrame:
    """Ids in all shards before each: a running sum over one row per shard (a shard is a task's share of the rows)."""
    w = Window.orderBy("first_id", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("shard", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("before"))


def shard_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shard, start (ids of all records before it), n_tokens, ids_crc32 of every record, from the files; the ids
    stay in the task. What precedes a shard goes to its task beside its name, so the records join nothing."""
    starts = shard_starts(spark.read.parquet(f"{folder}/_manifest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with _opened(f"{folder}/{shard}", "rb") as file:
                    rows = ((ident, shard, before + place, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for ident, place, ids in Reader(file))
                    while held := list(islice(rows, 4096)):
                        c = list(zip(*held, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c[0], pa.int64()), pa.array(c[1]), *(pa.array(x, pa.int64()) for x in c[2:])],
                            ["doc_id", "shard", "start", "n_tokens", "ids_crc32"],
                        )

    # A count of partitions is given, as one row a shard looks small enough to be read by one task.
    return starts.repartition(max(1, starts.count()), "shard").mapInArrow(run, "doc_id long, shard string, start long, n_tokens long, ids_crc32 long")
