"""Top-k against brute force; compaction as an exact round trip."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk
from tidemark.llm.common import shared_dir
from tidemark.llm.compaction import ShardStore


def test_topk(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(300, 19)), rng.normal(size=(4, 1)) * np.ones((4, 19)), np.zeros((3, 19))]).astype(np.float32)
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)] + [(20, x[20].tolist(), 0, 1)]
    bad = [(1000, None, 0, 1), (1020, [1.0, None], 0, 1), (1040, [float("nan")] * 19, 0, 1), (1060, [float("inf")] * 19, 0, 1), (1080, [1.0, 2.0], 0, 1), (None, [1.0] * 19, 0, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int, score int").repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.topk(df, lambda i: i % 20 == 0, k=7, block_rows=50).collect()}
    z = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    want = {}
    for q in range(0, len(z), 20):
        order = sorted((-int(s), i) for i, s in enumerate(z @ z[q]) if i != q)[:7]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(order)}
    assert got == want
    assert topk.topk(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert topk.block_topk(np.array([1]), [[1e12, 1e12]], np.array([1, 2]), [[0.0, 0.0], [1e12, -1e12]], 3) == [(1, 2, 0)]


@pytest.fixture
def store(spark):
    return ShardStore(spark, shared_dir(spark, "t-shards"), target_bytes=30_000, fanout=3, base_bytes=2_000)


def test_compaction_round_trip(spark, store):
    texts = [None, "", "a", "a", "é" * 500, "x" * 200_000]
    df = spark.createDataFrame([(i, texts[i % 6], ["s0", None, "s2", "s0"][i % 4], i) for i in range(400)], "doc_id long, text string, source string, __index int")
    want = sorted(df.collect(), key=lambda r: r.doc_id)
    store.append_batches(df.where("doc_id < 200"), df.source)
    for a in range(200, 400, 25):
        store.append(df.where(f"doc_id >= {a} and doc_id < {a + 25}").coalesce(1))
    before = store.manifest()
    assert len(before["runs"]) == 11
    after = store.compact()
    assert len(after["runs"]) < 9 and after["version"] > before["version"]
    tiers = [store._tier(e) for e in after["runs"]]
    assert all(tiers.count(t) < 3 for t in tiers)
    assert sorted(store.read().collect(), key=lambda r: r.doc_id) == want
    assert sorted(store.read(before["version"]).collect(), key=lambda r: r.doc_id) == want
    store.vacuum()
    assert sorted(store.read().collect(), key=lambda r: r.doc_id) == want and store.versions() == [after["version"]]
    store.append(df.limit(0))
    store.append(df.limit(1).selectExpr("doc_id", "'more' AS extra"))
    assert store.read().count() == 401 and store.read().where("extra = 'more'").count() == 1


def test_two_writers_both_commit(spark, store):
    df = spark.range(20).selectExpr("id AS doc_id", "'t' AS text")
    work = [threading.Thread(target=store.append, args=(df,)) for _ in range(3)]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert store.read().count() == 60 and store.versions() == [1, 2, 3]


def test_lone_run_and_no_batches(spark, store):
    df = spark.range(400).selectExpr("id AS doc_id", "repeat(sha2(string(id), 256), 4) AS text")
    store.append(df.repartition(16))
    before = store.manifest()["runs"]
    after = store.compact()["runs"]
    assert before[0]["files"] == 16 and len(after) == 1 and after[0]["files"] <= -(-before[0]["bytes"] // store.target_bytes)
    assert sorted(store.read().collect()) == sorted(df.collect())
    version = store.manifest()["version"]
    assert store.compact()["version"] == version  # nothing is left to do
    empty = ShardStore(spark, shared_dir(spark, "t-empty"))
    empty.append_batches(df.limit(0), F.col("text"))
    empty.compact()
    empty.vacuum()
    assert empty.read().dtypes == df.dtypes and empty.read().count() == 0


def test_vacuum_leaves_what_another_writer_is_about_to_commit(spark, store):
    df = spark.range(20).selectExpr("id AS doc_id", "'t' AS text")
    store.append(df)
    commit, other = store._commit, ShardStore(spark, store.root)

    def late(change, made, attempts=20):  # the other writer vacuums between the run and its commit
        other.append(df)
        other.vacuum()
        return commit(change, made, attempts)

    store._commit = late
    store.append(df)
    store._commit = commit
    assert store.read().count() == 60 and len(store.manifest()["runs"]) == 3
    for _ in range(3):
        store.append(df)
    store.compact()
    other.vacuum(orphan_hours=0.0)  # replaced runs go, live ones stay
    assert store.read().count() == 120 and store.versions() == [store.manifest()["version"]]
    left = [s.getPath().getName() for s in store.fs.listStatus(store._path("data"))]
    assert sorted(left) == sorted(e["run"] for e in store.manifest()["runs"])
    store.fs.mkdirs(store._path("data/run-lost"))
    other.vacuum()
    assert store.fs.exists(store._path("data/run-lost"))
    store.spark.sparkContext._jvm.Thread.sleep(20)
    other.vacuum(orphan_hours=0.0)
    assert not store.fs.exists(store._path("data/run-lost"))


def test_a_commit_whose_run_has_gone_fails(spark, store):
    df = spark.range(5).selectExpr("id AS doc_id", "'t' AS text")
    entry = {"run": "run-gone", "files": 1, "bytes": 1, "schema": {}}
    with pytest.raises(RuntimeError, match="run-gone"):
        store._commit(lambda runs: [*runs, entry], [entry])
    store.append(df)
    assert store.read().count() == 5 and store.versions() == [1]


def test_wide_components_by_whole_numbers():
    """Rows whose sums floats do not hold, beside rows of any other size; scores beyond 64 bits are held at its ends."""
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(400, 16)) * 10.0 ** rng.integers(0, 12, (400, 1)))
    x[7] *= 1e290
    x[8], x[9] = x[10], x[10] + 1
    ids = np.arange(400)
    got = topk.block_topk(ids[::20], list(x[::20]), ids, list(x), 9)
    exact = [[int(v) for v in r] for r in x]
    want = []
    for q in range(0, 400, 20):
        each = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(exact[q], exact[j], strict=True)))), j) for j in range(400) if j != q)[:9]
        want += [(q, j, -s) for s, j in each]
    assert got == want
    few = topk.block_topk(np.array([1]), [x[0]], np.array([1, 2]), [x[0], x[1]], 9)
    assert [r[:2] for r in few] == [(1, 2)]
