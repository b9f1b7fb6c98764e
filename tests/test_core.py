"""Operators on inputs that the test tables do not have: extremes, nulls, ties, restarts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as ag
from tidemark.operators import backtest as bt
from tidemark.operators import bars as br
from tidemark.operators import joins as jn
from tidemark.operators import windows as wn
from tidemark.sources import files
from tidemark.streaming import micro_batch as sm


def test_interval_sums_are_of_their_own_rows(spark):
    right = spark.createDataFrame([("a", 10, 1e17), ("a", 20, 1.0), ("a", 30, 2.0), ("a", 30, 0.5), ("b", 5, math.nan), ("b", 15, 4.0), ("a", -3, 7.0)], "k string, at long, v double")
    spans = [("a", 10, 20, 1.0), ("a", 20, 30, 2.5), ("a", 9, 10, 1e17), ("a", -10, 0, 7.0), ("a", 20, 20, 0.0), ("a", 0, 1000, 1e17), ("b", 10, 20, 4.0), ("c", 0, 9, 0.0), (None, 0, 9, 0.0), ("a", None, 9, 0.0)]
    left = spark.createDataFrame([(*s, 1) for s in spans] + [(*spans[0], 2)], "k string, s long, e long, want double, v int")
    for width in (1, 7, 1000):
        got = jn.interval_sum(left, right, "k", "s", "e", "at", "v", "sum", width).collect()
        assert len(got) == len(spans) + 1 and all(r["sum"] == r.want for r in got), got


def test_digests(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "x string, y string")
    digest = lambda df: ag.content_digest(df).first()
    assert digest(rows(("a", None))) != digest(rows((None, "a"))) != digest(rows(("", "a")))
    assert digest(rows(("a", "b"), ("c", None))) == digest(rows(("c", None), ("a", "b")).repartition(3))
    assert digest(rows(("a", "b"), ("a", "b"))) != digest(rows(("a", "b")))
    assert digest(rows(("a", "b")).withColumnRenamed("x", "z")) != digest(rows(("a", "b")))
    assert digest(rows(("1:a;", ""))) != digest(rows(("1", "a;")))
    path = str(tmp_path / "once")
    assert files.write_immutable(rows(("a", None)), path) and not files.write_immutable(rows(("a", None)), path)
    with pytest.raises(ValueError):
        files.write_immutable(rows((None, "a")), path)
    nested = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    assert digest(nested).n_rows == 1


def test_neighbours_across_stretches(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(500), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    want = {}
    for g in ("a", "b", None):
        before = None
        for r in sorted((o, v) for h, o, v in rows if h == g):
            want[g, r] = before
            before = r[1]
    for width in (1, 13, 10_000):
        got = {(r.g, (r.o, r.v)): r.prev and r.prev.v for r in wn.previous(df, ["g"], ["o", "v"], ["v"], width).collect()}
        assert got == want
        numbered = {(r.o, r.v): r.n for r in wn.ranked(df, ["o", "v"], "n", width).collect()}
        assert [numbered[k] for k in sorted(numbered)] == list(range(300))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    groups = {"n": rng.normal(size=501), "t": rng.integers(0, 3, 200).astype(float), "one": np.array([4.0]), "out": np.append(rng.random(99), 1e12), "same": np.full(7, 2.0)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("none", None)]
    at = {"q0": 0.0, "q1": 0.1, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = {r.g: r for r in ag.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", at, cells=16).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert np.allclose([got[g][n] for n in at], np.quantile(x, list(at.values())), rtol=1e-12)


def test_folds_join_by_stretch(spark):
    folds = spark.createDataFrame([(0, 0, 50), (1, 0, 120), (2, 121, 121)], "fold int, low long, high long")
    df = spark.createDataFrame([(t,) for t in range(0, 130, 3)] + [(121,)], "t long")
    got = sorted((r.fold, r.t) for r in jn.with_folds(df, folds, "t", "low", "high", width=10).collect())
    assert got == sorted((f, t) for f, a, z in ((0, 0, 50), (1, 0, 120), (2, 121, 121)) for (t,) in df.collect() if a <= t <= z)
    made = bt.folds(spark.createDataFrame([(i * 10,) for i in range(20)], "t long"), 5, 4, 1, width=37).orderBy("fold").collect()
    assert [(r.fold, r.train_start, r.train_end, r.test_start, r.test_end) for r in made] == [(0, 0, 40, 60, 90), (1, 0, 80, 100, 130), (2, 0, 120, 140, 170)]


def test_replay_is_one_stream(spark):
    rows = [("x", 3, "2024-01-01 00:00:02"), ("y", 1, "2024-01-01 00:00:01"), ("x", 2, "2024-01-01 00:00:01"), ("y", 9, "2024-01-01 05:00:00")]
    e = spark.createDataFrame(rows, "event_type string, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.event_id: r.delay_ms for r in sm.replay_schedule(e, 10.0).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 100.0, 9: (5 * 3600 - 2) * 100.0}
    once, again = sm.replay_digest(e).first(), sm.replay_digest(e.repartition(3).orderBy(F.rand(1))).first()
    assert once == again and once.n_rows == 4
    assert sm.replay_digest(e.withColumn("event_id", F.col("event_id") + 1)).first() != once


def test_windowed_bars(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, "a", 1.0, 0), (2, "a", 2.0, 10), (5, "a", 3.0, 20), (4, "a", 4.0, 30), (1, "b", 5.0, 4000)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, value double, s long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")))
    df.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(df.schema).parquet(source)
    sm.windowed_bars(stream()).writeStream.format("memory").queryName("bars").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    bars = {r.event_type: r for r in spark.table("bars").collect()}
    assert (bars["a"].open, bars["a"].high, bars["a"].close, bars["a"].trades) == (1.0, 4.0, 4.0, 4)


def test_audit_of_bars(spark):
    rows = [("s", 0, 1.0, 2.0, 0.5, 1.5, 3.0, 1), ("s", 1, 0.0, 2.0, 0.0, 1.5, 3.0, 1), ("s", 2, -1.0, 2.0, -1.0, 1.5, -3.0, 0), ("s", 3, 1.0, 0.9, 0.5, math.nan, 3.0, 0)]
    got = br.audit_bars(spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double, trades long"), 1, 1, 2).first()
    assert (got.negative_price, got.negative_volume, got.not_finite, got.invalid_ohlc, got.empty_with_volume, got.out_of_range) == (1, 1, 1, 1, 1, 2)
