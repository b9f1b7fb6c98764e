"""Best-fit packing of documents into fixed-length sequences after a dominance reduction.

Documents are tokenized once; their pieces (at most ``capacity`` tokens) are written to the shared folder. How many
pieces there are of each length is a histogram of at most ``capacity`` rows, whatever the input, and only that goes to
the driver, which makes a plan: fillings (a multiset of lengths and how many sequences have it). The plan has at most a
few fillings a length. Executors then number the pieces of each length (counts per task and length, summed) and look
the number up in the plan, so no group of equal lengths is ever gathered.

Reduction (Martello and Toth): a set of pieces that fits one sequence dominates another if the other's pieces can be
put, each into one of the set's, without overlap; if one set that holds piece j dominates all that hold j, some optimal
packing has it, so it is fixed and taken out, and the rest is reduced again. Checked for every length, largest first,
for sets of up to three pieces: j alone if nothing fits beside it; j with a partner that fills the sequence exactly, or
with the largest partner that fits if that is no smaller than any two that fit together (and no three do); j with a
pair that fits, if its larger piece is the largest that fits at all and its smaller one no smaller than the smaller one
of any pair. A rule that holds keeps holding while pieces are only taken out, so as many equal sets as there are pieces
for are fixed at once.

The remainder goes by best fit: pieces in descending order, each into the sequence with the least room that holds it,
over groups of equally filled sequences, so that the work is by lengths, not by pieces. A second plan fills sequences one
by one, in order of their largest piece, by the multiset that leaves the least space (an exact subset sum); plans that
do so down to some length and go on by best fit follow. The plan with the fewest sequences stands, the first among
equals, and the search ends at the lower bound; best fit without the reduction is among them, so the plan never has more.

A null text is as an empty one: one end id. Repeated rows are packed each. Empty table: empty result. Other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .tokens import encoder

PIECES = "part int, lrank long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than capacity where n is larger."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; lrank numbers the pieces of a length within a task (part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, part, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows = []
            for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = e.ids(text or "")
                ids.append(end_id)
                raw = np.asarray(ids, "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((part, int(seen[length]), ident, k, start, length, zlib.crc32(raw[start : start + length].tobytes())))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def _fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths from the histogram that fill room best; among equals, larger ones first."""
    reach = np.zeros(room + 1, np.int64)  # reach[s]: 1 + largest length used last on the way to s, in descending order of lengths
    reach[0] = -1
    for length in range(min(room, len(counts) - 1), 0, -1):
        n = int(min(counts[length], room // length))
        if not n:
            continue
        if reach[room]:
            break
        frontier = np.flatnonzero(reach)
        for _ in range(n):
            frontier = frontier[frontier + length <= room] + length
            frontier = frontier[reach[frontier] == 0]
            if not len(frontier):
                break
            reach[frontier] = length
    best = int(np.flatnonzero(reach)[-1])
    out = []
    while best:
        out.append(int(reach[best]))
        best -= out[-1]
    return out


Filling = tuple[list[int], int]


def reduced(counts: np.ndarray) -> list[Filling]:
    """Sets fixed by dominance, as many as the histogram has pieces for; takes them out of counts."""
    capacity, out = len(counts) - 1, []

    def fix(*filling: int) -> None:
        used = np.bincount(filling, minlength=capacity + 1)
        n = int((counts[used > 0] // used[used > 0]).min())
        counts[:] -= n * used
        out.append((list(filling), n))

    def rule(j: int) -> tuple[int, ...] | None:
        room = capacity - j
        counts[j] -= 1
        have = np.flatnonzero(counts[: room + 1])
        number = counts[have]
        counts[j] += 1
        if not len(have):
            return (j,)
        top = int(have[-1])
        if top == room:
            return (j, top)
        small = np.repeat(have, np.minimum(number, 3))[:3]
        if len(small) >= 3 and small.sum() <= room:
            return None  # three fit beside j: none of these rules decides
        # Pairs (x, y), x >= y, that fit beside j: for each y the largest x.
        x = have[np.searchsorted(have, room - have, side="right") - 1]
        ok = (have + have[0] <= room) & ((x > have) | (x == have) & (number > 1))
        if not ok.any():
            return (j, top)
        y, x = have[ok], x[ok]
        if top >= int((x + y).max()):
            return (j, top)
        if int(x[-1]) == top:  # the pair with the largest possible smaller piece has the largest piece of all, too
            return (j, top, int(y[-1]))
        return None

    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(counts)[::-1].tolist():
            while counts[j] and (found := rule(j)):
                fix(*found)
                changed = True
    return out


def best_fit(counts: np.ndarray) -> list[Filling]:
    """Best-fit decreasing over a histogram."""
    capacity = len(counts) - 1
    room: dict[int, list[Filling]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        for r in sorted(k for k in room if k >= length):
            each = r // length
            groups, room[r] = room[r], []
            for filling, n in groups:
                full = min(n, left // each)
                left -= full * each
                last = left if full < n else 0
                left -= last
                for made, k, m in ((filling + [length] * each, full, each), (filling + [length] * last, 1 if last else 0, last), (filling, n - full - (1 if last else 0), 0)):
                    if k:
                        room.setdefault(r - m * length, []).append((made, k))
            if not left:
                break
        each = capacity // length
        full, last = divmod(left, each)
        for k, m in ((full, each), (1 if last else 0, last)):
            if k:
                room.setdefault(capacity - m * length, []).append(([length] * m, k))
    return [f for fs in room.values() for f in fs]


def fullest_first(counts: np.ndarray, down_to: int) -> list[Filling]:
    """Sequences filled as full as can be in order of their largest piece, down to a length; best fit for the rest."""
    counts, out = counts.copy(), []
    while counts[down_to:].any():
        largest = int(np.flatnonzero(counts)[-1])
        counts[largest] -= 1
        filling = [largest, *_fullest(counts, len(counts) - 1 - largest)]
        counts[largest] += 1
        used = np.bincount(filling, minlength=len(counts))
        n = int((counts[used > 0] // used[used > 0]).min())
        counts -= n * used
        out.append((filling, n))
    return out + best_fit(counts)


def plan(histogram: dict[int, int], capacity: int = 1024) -> list[Filling]:
    """Fillings [(lengths in order, number of sequences)] that use every piece of the histogram once."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    whole, rest = counts.copy(), counts
    fixed = reduced(rest)
    size = lambda fillings: sum(n for _, n in fillings)
    bound = -(-int(rest @ np.arange(capacity + 1)) // capacity)
    made = best_fit(rest)
    for down_to in (capacity // 2, capacity // 4, capacity // 8, 3 * capacity // 4, 1):
        if size(made) == bound:
            break
        made = min(made, fullest_first(rest, down_to), key=size)
    plain = best_fit(whole)
    return plain if size(plain) < size(fixed) + size(made) else fixed + made


def pack(made: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces()' rows with sequence_id and offset; ``made`` must be a written table, as part and lrank must not change."""
    spark = made.sparkSession
    per_part = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = per_part.select(F.col("part").alias("b_part"), F.col("length").alias("b_length"), F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    slots, sequences, given = [], 0, {}
    for filling, n in plan(histogram, capacity):
        offset = 0
        used: dict[int, list[int]] = {}
        for length in filling:
            used.setdefault(length, []).append(offset)
            offset += length
        for length, offsets in used.items():
            slots.append((length, given.get(length, 0), given.get(length, 0) + n * len(offsets), sequences, offsets))
            given[length] = slots[-1][2]
        sequences += n
    table = spark.createDataFrame(slots, "s_length long, low long, high long, first_sequence long, offsets array<long>")
    ranked = made.join(bases, (made.part == bases.b_part) & (made.length == bases.b_length)).withColumn("rank", F.col("lrank") + F.col("base"))
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    k = F.col("rank") - F.col("low")
    each = F.size("offsets")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(k / each)).cast("long").alias("sequence_id"),
        F.get("offsets", (k % each).cast("int")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece. Eager up to the written pieces."""
    return pack(written(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces"), capacity)
