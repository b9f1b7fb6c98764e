"""Cost-balanced packing of documents into sequences of a fixed length.

The cost of a piece is linear in its tokens (the layers' products) plus quadratic (its attention within itself). Pieces
are taken in descending order, and each goes to the sequence with the lowest cost among those that have room for it; one
that fits nowhere fills the sequence with the most room, and what is left of it takes its place further down the order.
A document longer than a sequence is cut into whole sequences first. So all sequences but the last are exactly full, and
the cost is spread as the order allows.

Sequences are made within a task, a block of about ``block`` of them at a time, with what a block leaves over (less than
a sequence) handed to the next; nothing is shuffled, gathered on the driver or looked up, and a lost task is done again
from its own rows. At the end of a task what is left goes into sequences whose lengths are powers of two, which need no
padding. The blocks' size bounds memory; it leaves out nothing.

A null text is an empty one: the end id alone. Repeated rows are packed each, rows without an id too. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import encoder

PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Piece = tuple[int, int, int]  # document (its number in the block), start, length
Placed = tuple[int, int, int, int, int]  # document, start, length, sequence, offset


def piece_cost(length: int, width: int = 1024) -> int:
    """Operations of a transformer layer on a piece, by 4 x width: 24 width^2 a token and 4 width a pair of tokens."""
    return 6 * width * length + length * length


def assign(pieces: list[Piece], rooms: list[int], cost=piece_cost) -> tuple[list[Placed], list[Piece]]:
    """Pieces placed in sequences with the given rooms, and the pieces that no room is left for.

    Among sequences of equal cost the first is taken, among pieces of equal length the first given."""
    longest = max((p[2] for p in pieces), default=0)
    waiting: list[list[Piece]] = [[] for _ in range(longest + 1)]
    for p in pieces:
        waiting[p[2]].append(p)
    top = max([longest, *rooms], default=0)
    parked: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]  # by room: (cost, sequence) too small for the present length
    room, filled = list(rooms), [0] * len(rooms)
    for s, r in enumerate(rooms):
        heapq.heappush(parked[r], (0, s))
    fitting: list[tuple[int, int]] = []  # (cost, sequence) with room for the present length
    placed, left, largest = [], [], top

    def put(piece: Piece, c: int, s: int, length: int) -> None:
        document, start, n = piece
        placed.append((document, start, length, s, filled[s]))
        filled[s] += length
        room[s] -= length
        if n > length:
            waiting[n - length].append((document, start + length, n - length))
        c += cost(length)
        if room[s] >= n:
            heapq.heappush(fitting, (c, s))
        elif room[s]:
            heapq.heappush(parked[room[s]], (c, s))

    for length in range(longest, 0, -1):
        while largest >= length:
            for x in parked[largest]:
                heapq.heappush(fitting, x)
            parked[largest] = []
            largest -= 1
        at, below = 0, length - 1
        while at < len(waiting[length]):
            piece = waiting[length][at]
            at += 1
            if fitting:
                put(piece, *heapq.heappop(fitting), length)
                continue
            while below and not parked[below]:
                below -= 1
            if not below:
                left.append(piece)
            else:
                put(piece, *heapq.heappop(parked[below]), below)
        waiting[length] = []
    return placed, left


def whole(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of n ids cut into whole sequences and a rest."""
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)]


def tail(n: int) -> list[int]:
    """Powers of two that sum up to n, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def pack_by_cost(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, width: int = 1024, block: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, sequence = encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, np.ndarray]] = []  # (id, ids) of the documents in the block
        pieces: list[Piece] = []
        tokens = 0

        def emit(rooms: list[int]) -> pa.RecordBatch:
            nonlocal held, pieces, tokens, sequence
            placed, left = assign(pieces, rooms, lambda n: piece_cost(n, width))
            rows, ids = [], []
            for document, start, length, s, offset in placed:
                ident, all_ids = held[document]
                raw = all_ids[start : start + length].tobytes()
                rows.append((ident, start, length, zlib.crc32(raw), len(all_ids), sequence + s, offset))
                if with_ids:
                    ids.append(all_ids[start : start + length])
            sequence += len(rooms)
            keep = {d: i for i, d in enumerate(dict.fromkeys(p[0] for p in left))}
            held, pieces = [held[d] for d in keep], [(keep[d], s, n) for d, s, n in left]
            tokens = sum(p[2] for p in pieces)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 7
            names = [c.split()[0] for c in PACKED.split(", ")]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = e.ids(text or "")
                ids.append(end_id)
                raw = np.asarray(ids, "<u4")
                pieces += [(len(held), s, n) for s, n in whole(len(raw), capacity)]
                held.append((ident, raw))
                tokens += len(raw)
                if tokens >= block * capacity:
                    yield emit([capacity] * (tokens // capacity))
        if pieces:
            yield emit([capacity] * (tokens // capacity) + tail(tokens % capacity))

    small_batches(docs.sparkSession)
    schema = PACKED + (", ids array<long>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def sequence_costs(packed: DataFrame, width: int = 1024) -> DataFrame:
    """sequence_id, tokens, cost: for reports of how even the costs are."""
    n = F.col("length")
    return packed.groupBy("sequence_id").agg(F.sum(n).alias("tokens"), F.sum(n * (6 * width) + n * n).alias("cost"))
