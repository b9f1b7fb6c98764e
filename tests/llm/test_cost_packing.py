"""Cost-balanced packing: the rule against a plain search over all sequences, exact round trips, padding and balance."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import cost_packing as cp

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(pieces, rooms):
    """The same rule by looking at every sequence for every piece."""
    room, cost, filled, placed, left = list(rooms), [0] * len(rooms), [0] * len(rooms), [], []
    queue = [[p for p in pieces if p[2] == n] for n in range(max((p[2] for p in pieces), default=0) + 1)]
    for n in range(len(queue) - 1, 0, -1):
        while queue[n]:
            d, start, _ = queue[n].pop(0)
            fits = [s for s in range(len(rooms)) if room[s] >= n]
            most = max(room, default=0)
            if fits:
                s, length = min(fits, key=lambda s: (cost[s], s)), n
            elif most:
                s, length = min((s for s in range(len(rooms)) if room[s] == most), key=lambda s: (cost[s], s)), most
            else:
                left.append((d, start, n))
                continue
            placed.append((d, start, length, s, filled[s]))
            filled[s] += length
            room[s] -= length
            cost[s] += cp.piece_cost(length)
            if length < n:
                queue[n - length].append((d, start + length, n - length))
    return placed, left


@pytest.mark.parametrize("seed", range(60))
def test_the_rule_against_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    pieces = [(i, 0, int(n)) for i, n in enumerate(rng.integers(1, 40, int(rng.integers(1, 80))))]
    total = sum(p[2] for p in pieces)
    rooms = [40] * (total // 40) + (cp.tail(total % 40) if seed % 2 else [])
    placed, left = cp.assign(pieces, rooms)
    assert (placed, left) == plain(pieces, rooms)
    assert sum(p[2] for p in placed) == sum(rooms) and sum(p[2] for p in left) == total - sum(rooms)


def check(docs, rows, capacity=2048):
    """Every id in one piece, sequences gapless and within capacity, crcs of the library's own ids."""
    t = Tokenizer.from_file(PATH)
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for d, x in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, x in ids.items():
        at = 0
        for start, length in sorted(by_doc[d]):
            assert start == at and length > 0
            at += length
        assert at == len(x)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0
    return by_sequence


def test_documents_round_trip(spark):
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(rng.choice(["river", "stone", "Über", "<|endoftext|>", "x1"], int(n)))) for i, n in enumerate(rng.geometric(0.003, 300))]
    docs += [(1000, None), (1001, ""), (1002, "long " * 20_000), (1003, "same"), (1004, "same")]
    df = spark.createDataFrame([(*x, 7) for x in docs], "doc_id long, text string, start long").repartition(3)
    rows = cp.pack_by_cost(df, PATH, block=8, with_ids=True).collect()
    sequences = check(docs, rows)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    total = sum(r.length for r in rows)
    assert len(sequences) <= total // 2048 + 3 * 11
    assert cp.pack_by_cost(df, PATH, block=8).count() == len(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string").coalesce(1)
    rows = cp.pack_by_cost(df, PATH).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 2 + 1 and sum(r.doc_id is None for r in rows) >= 2
    assert cp.pack_by_cost(df.where("doc_id > 5"), PATH).count() == 0


def test_costs_are_more_even_than_in_the_order_of_arrival():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(5.5, 1, 5000).astype(int) + 1, 800)
    rooms = [2048] * (int(lengths.sum()) // 2048)
    placed, _ = cp.assign([(i, 0, int(n)) for i, n in enumerate(lengths)], rooms)
    balanced = np.zeros(len(rooms))
    for _, _, n, s, _ in placed:
        balanced[s] += n * n
    ends = np.cumsum(lengths)
    cuts = np.unique(np.concatenate([ends, np.arange(1, len(rooms) + 1) * 2048]))
    cuts = cuts[cuts <= len(rooms) * 2048]
    size = np.diff(np.concatenate([[0], cuts]))
    arrival = np.bincount((cuts - 1) // 2048, size.astype(float) ** 2, len(rooms))
    assert balanced.std() < 0.6 * arrival.std()
