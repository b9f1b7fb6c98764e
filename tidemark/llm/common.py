"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir, or a local one where that is unset (local mode, tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written() that no later plan reads."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column (null: empty), without making Python strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


SLICE = 1 << 20


def slices(offsets: np.ndarray, most: int = SLICE):
    """(from row, to row) of neighbouring rows of about ``most`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def release() -> None:
    """Hand memory that is free again back to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call outside of glibc
        pass


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long rows: 1,000 of them make a batch for Python, unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_rng = np.random.default_rng(0x7E57)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x5851F42D4C957F2D, i, 1 << 64) for i in range(64)], np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * np.full(1, pow(0x5851F42D4C957F2D, len(_POWERS), 1 << 64), np.uint64)])
    return _POWERS


def word_hashes(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text with A-Z lower-cased, as 64-bit hashes.

    Returns (hash, byte start, byte end, row of the text) per word; starts and ends are positions in raw. Other bytes
    than white space can separate words by ``separator``, a mask over byte values.
    """
    if not len(raw):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    if len(raw) > SLICE and len(offsets) > 2:  # whole rows at a time, for the size of what is made on the way
        parts = []
        for i, j in slices(offsets):
            h, start, end, row = word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], separator)
            parts.append((h, start + offsets[i], end + offsets[i], row + i))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    inside = ~separator[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_of_text = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_of_text] = inside[starts_of_text]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_of_text = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends_of_text] = inside[ends_of_text]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    if not len(start):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    at = np.flatnonzero(inside)
    length = end - start
    place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    powers = _powers(int(length.max()) + 1)
    value = _BYTE_LOWER[raw[at]] * powers[place]
    h = np.add.reduceat(value, np.cumsum(length) - length)
    h = mix64(h + length.astype(np.uint64) * _STEP)
    row = np.searchsorted(offsets, start, side="right") - 1
    return h, start, end, row


def shingle_hashes(words: np.ndarray, row: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, concatenated, and n_rows+1 offsets.

    A row with fewer than ``size`` words has one shingle, its whole word sequence; one without words has none.
    """
    count = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    begin = np.concatenate([[0], np.cumsum(count)])
    full = max(0, len(words) - size + 1)
    h = np.full(full, size, np.uint64) * _STEP
    for k in range(size):
        h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + words[k : k + full])
    ok = row[:full] == row[size - 1 :] if full else np.zeros(0, bool)
    h, r = h[ok], row[:full][ok]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, s in enumerate(short):
            v = np.full(1, count[s], np.uint64) * _STEP
            for k in range(begin[s], begin[s + 1]):
                v = mix64(v * np.uint64(0x2545F4914F6CDD1D) + words[k : k + 1])
            extra[i] = v[0]
        h, r = np.concatenate([h, extra]), np.concatenate([r, short])
    out, sizes = [], np.zeros(n_rows, np.int64)
    if len(h):
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
        bounds = np.searchsorted(r, np.arange(n_rows + 1))
        for i in range(n_rows):
            if bounds[i] < bounds[i + 1]:
                u = np.unique(h[bounds[i] : bounds[i + 1]])
                out.append(u)
                sizes[i] = len(u)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])

