"""Token counts, shards and packing against the tokenizers library itself."""

import io
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, sstable, token_counts
from tidemark.llm.common import shared_dir
from tidemark.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n", "It's 12 o'clock!! I'LL go.", "a<|endoftext|>b <|startoftext|>", "áb İX ½ ² ΑΣ ΑΣ.", "日本語 text ﬁ", "the same", "the same",
    "é è " * 9000, "x" * 70_000, " ".join(f"word{i} th'ere  {i}\n" for i in range(9000)), "\t" * 40_000 + "end",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, id int, shard int").repartition(3)


def ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_counts(docs, path):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path, chunk_chars=1000, overlap_chars=8).collect()}
    for i, t in enumerate(TEXTS):
        n = len(ids(path, t))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048), i
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder(path):
    e = Encoder(path, most=3)
    for t in TEXTS:
        assert list(e.ids(t or "")) == ids(path, t) and e.count(t or "") == len(ids(path, t))


def test_shards_round_trip(spark, docs):
    folder = shared_dir(spark, "t-sst")
    sstable.write_shards(docs, folder, WORD, block_bytes=500)
    rows = {r.doc_id: r for r in sstable.shard_digests(spark, folder).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        want = [*ids(WORD, t), 2]
        assert rows[i].start == start and rows[i].n_tokens == len(want)
        assert rows[i].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert {r.doc_id: r.ids for r in sstable.read_shards(spark, folder).collect()} == {i: [*ids(WORD, t), 2] for i, t in enumerate(TEXTS)}
    empty = shared_dir(spark, "t-sst")
    sstable.write_shards(docs.limit(0), empty, WORD)
    assert sstable.read_shards(spark, empty).count() == 0 and sstable.shard_digests(spark, empty).count() == 0


def test_shards_null_and_repeated_ids(spark):
    rows = [(None, "no key", 1), (None, None, 1), (7, "b", 1), (7, "a", 1), (-3, "", 1)]
    folder = shared_dir(spark, "t-sst")
    sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3), folder, WORD)
    got = sorted(sstable.shard_digests(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -3, 7, 7]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert sstable.read_shards(spark, folder, "key").where("key is null").count() == 2


def test_shard_lookup():
    sink = io.BytesIO()
    w = sstable.Writer(sink, 2, block_bytes=64)
    keys = [None, None, -5, -5, 0, 3, 3, 3, *range(10, 4000, 7), 2**62]
    for k in keys:
        w.add(k, [abs(k or 0) % 1000, 2])
    w.close()
    r = sstable.Reader(sink)
    assert [k for k, _, _ in r] == keys and r.records == len(keys)
    for k in {*keys, 1, 11, -6, 2**62 + 1}:
        assert [list(x) for x in r.get(k)] == [[abs(k or 0) % 1000, 2]] * keys.count(k)
    with pytest.raises(ValueError):
        w.add(1, [1])


def test_packing(spark, docs):
    rows = packing.pack_documents(docs, BYTE, capacity=64).collect()
    want = {}
    for i, t in enumerate(TEXTS):
        x = np.array([*ids(BYTE, t), 2], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(x), 64)):
            want[i, k] = (s, n, zlib.crc32(x[s : s + n].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in g:
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


def test_plan_is_as_small_as_the_best():
    def best(sizes, cap):
        sizes, found = sorted(sizes, reverse=True), [len(sizes)]

        def go(i, bins):
            if len(bins) >= found[0]:
                return
            if i == len(sizes):
                found[0] = len(bins)
                return
            for j in {b: j for j, b in enumerate(bins)}.values():
                if bins[j] + sizes[i] <= cap:
                    go(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
            go(i + 1, [*bins, sizes[i]])

        go(0, [])
        return found[0]

    rng, over = np.random.default_rng(1), 0
    for _ in range(150):
        cap = int(rng.integers(5, 20))
        sizes = rng.integers(1, cap + 1, int(rng.integers(1, 11))).tolist()
        got = packing.plan({s: sizes.count(s) for s in sizes}, cap)
        assert sorted(s for f, n in got for s in f * n) == sorted(sizes)
        assert all(sum(f) <= cap for f, _ in got)
        over += sum(n for _, n in got) - best(sizes, cap)
    assert over <= 2
    many = packing.plan({int(s): int(n) for s, n in enumerate(rng.integers(1, 10**9, 1025)) if s}, 1024)
    assert len(many) < 10_000
    total = sum(sum(f) * n for f, n in many)
    assert sum(n for _, n in many) <= 1.02 * total / 1024 + 1  # half of these are over half a sequence, so the sum is no tight bound
