"""The micro-batch store when writers die and disks lie, and the sequence counters."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import sequences as sq
from tidemark.streaming.store import MicroBatchStore, admission

SCHEMA = "event_id long, event_type string, symbol string, ts timestamp, value double"


def events(spark, ids, hot=0.9):
    rows = [(int(i), "trade" if i % 10 < hot * 10 else "quote", None if i % 97 == 5 else "AB"[i % 2], None, float(i)) for i in ids]
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")))


@pytest.fixture
def store(spark, tmp_path):
    return MicroBatchStore(spark, f"file://{tmp_path}/store", events(spark, []).schema, max_rows=100)


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def files(store):
    top = store.path.removeprefix("file://") + "/data"
    return sorted(os.path.join(d, f) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet"))


def test_files_are_bounded_and_hot_keys_split(spark, store, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join tasks of so little data
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    assert store.read().count() == 0 and store.checkpoints().count() == 0 and set(store.recover().values()) == {0}
    assert store.write(events(spark, range(2000)), 0) and not store.write(events(spark, range(2000)), 0)
    log = store.log().collect()
    assert ids(store.read()) == list(range(2000)) and sum(r.n_rows for r in log) == 2000 and max(r.n_rows for r in log) <= 100
    hot = [r for r in log if "event_type=trade/symbol=A" in r.path]
    assert len(hot) >= 9 and len({r.path.split("part-")[1][:5] for r in hot}) > 1  # of several tasks
    marks = {(r.event_type, r.symbol): r for r in store.checkpoints().collect()}
    assert set(marks) == {(e, s) for e in ("trade", "quote") for s in ("A", "B", None)} - {("quote", "A")} | {("quote", None)}
    assert marks["trade", "A"].last_id == "1998" and sum(r.n_rows for r in marks.values()) == 2000
    assert store.read().columns == ["event_id", "event_type", "symbol", "ts", "value"]
    store.write(events(spark, []), 1)
    assert store.batches() == ([0, 1], [], [])


def test_killed_between_write_and_commit(spark, store, tmp_path, monkeypatch):
    source, state = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    put = lambda x: events(spark, x).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    put(range(50))
    store.start(stream(), state, once=True).awaitTermination()
    put(range(50, 80))

    def die(number):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "commit", die)
        with pytest.raises(Exception, match="killed"):
            store.start(stream(), state, once=True).awaitTermination()
    assert ids(store.read()) == list(range(50)) and store.batches() == ([0], [1], [])
    again = MicroBatchStore(spark, store.path, events(spark, []).schema, max_rows=100)
    assert again.recover()["adopted_batches"] == 1 and ids(again.read()) == list(range(80))
    put(range(80, 90))
    again.start(stream(), state, once=True).awaitTermination()  # the killed batch is replayed and known
    assert ids(again.read()) == list(range(90)) and again.batches() == ([0, 1, 2], [], [])
    assert max(int(r.last_id) for r in again.checkpoints().collect()) == 89


def test_half_written_batches_are_written_again(spark, store):
    store.write(events(spark, range(30)), 0)
    store.write(events(spark, range(30, 60)), 1)
    top = store.path.removeprefix("file://")
    os.rename(f"{top}/log/batch=1", f"{top}/log/batch=1.x.tmp")
    os.unlink(f"{top}/data/batch=1/_SUCCESS")
    assert store.batches() == ([0], [], [1]) and ids(store.read()) == list(range(30))
    assert store.recover()["half_written"] == 1 and store.batches() == ([0], [], [])
    assert store.write(events(spark, range(30, 60)), 1) and ids(store.read()) == list(range(60))


def test_bad_files_are_quarantined_and_strays_adopted(spark, store):
    store.write(events(spark, range(600)), 0)
    before = store.log().count()
    one, two, three = [f for f in files(store) if "symbol=A" in f and "trade" in f][:3]
    lost = {r.event_id for f in (one, two, three) for r in spark.read.parquet(f"file://{f}").collect()}
    with open(one, "r+b") as f:  # cut short
        f.truncate(os.path.getsize(one) // 2)
    with open(two, "wb") as f:  # no Parquet at all
        f.write(b"nothing")
    os.unlink(three)
    stray = os.path.join(os.path.dirname(three), "part-stray.parquet")
    events(spark, [1000, 1002]).drop("event_type", "symbol").coalesce(1).write.parquet(f"file://{stray}.d")
    os.rename(next(os.path.join(f"{stray}.d", n) for n in os.listdir(f"{stray}.d") if n.endswith(".parquet")), stray)
    for n in os.listdir(f"{stray}.d"):
        os.unlink(os.path.join(f"{stray}.d", n))
    os.rmdir(f"{stray}.d")
    got = store.recover()
    assert got == {"half_written": 0, "adopted_batches": 0, "adopted_files": 1, "quarantined_files": 2, "missing_files": 1}
    assert ids(store.read()) == sorted(set(range(600)) - lost | {1000, 1002})
    log = {r.state: r.n for r in store.log().groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert log == {"valid": before - 2, "quarantined": 2, "missing": 1}
    assert next(r.last_id for r in store.checkpoints().collect() if (r.event_type, r.symbol) == ("trade", "A")) == "1002"
    assert store.recover()["quarantined_files"] == 0 and ids(store.read()) == sorted(set(range(600)) - lost | {1000, 1002})


def test_a_batch_without_identifiers_is_not_valid(spark, store):
    store.write(events(spark, range(10)).withColumn("event_id", F.when(F.col("event_id") > 4, F.col("event_id"))), 0)
    states = {r.state for r in store.log().collect()}
    assert "quarantined" in states and store.checkpoints().where("last_id IS NULL").count() == 0


def test_admission():
    assert admission("kafka", 5000, 10) == {"maxOffsetsPerTrigger": "5000", "minOffsetsPerTrigger": "5000", "maxTriggerDelay": "10s"}
    assert admission("rate-micro-batch", 7) == {"rowsPerBatch": "7"}
    with pytest.raises(ValueError, match="socket"):
        admission("socket", 1)


def test_advance_is_the_loop():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.integers(0, 12, int(rng.integers(1, 20)))
        last = None if rng.random() < 0.3 else int(rng.integers(0, 12))
        prev, missing, back = last, 0, 0
        for i in x:
            if prev is not None:
                missing += max(0, int(i) - prev - 1)
                back += int(i) <= prev
            prev = int(i)
        assert sq.advance(last, x) == (prev, missing, back)


def test_sequence_counters(spark, tmp_path):
    """Counts go on over micro-batches; a connection without events for long is closed once and begins anew."""
    source, schema = f"file://{tmp_path}/in", "conn string, symbol string, id long, ts timestamp"

    def run(*rows):
        df = spark.createDataFrame(rows, "conn string, symbol string, id long, at long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at"))).drop("at")
        df.coalesce(1).write.mode("append").parquet(source)
        q, seen = sq.sequence_counters(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "conn", "symbol", "id", "ts", 100_000, "1 second"), []
        w = q.writeStream.option("checkpointLocation", f"file://{tmp_path}/state").outputMode("update")
        w.foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).trigger(availableNow=True).start().awaitTermination(60)
        return set(seen)

    first = run(("c1", "A", 1, 0), ("c1", "A", 2, 1), ("c1", "A", 5, 2), ("c1", "B", 9, 3), ("c2", "A", 7, 4), ("c2", None, 7, 4), ("c2", "A", None, 4))
    assert first == {("c1", "A", 5, 2, 0, 3, False), ("c1", "B", 9, 0, 0, 1, False), ("c2", "A", 7, 0, 0, 1, False)}
    assert run(("c1", "A", 4, 5), ("c1", "A", 5, 6), ("c1", "B", 12, 7)) == {("c1", "A", 5, 2, 1, 5, False), ("c1", "B", 12, 2, 0, 2, False)}
    later = run(("c2", "A", 8, 90), ("c1", "A", 6, 91)) | run(("c2", "A", 9, 300))
    assert {x for x in later if x[-1]} == {("c1", "A", 6, 2, 1, 6, True), ("c1", "B", 12, 2, 0, 2, True)} and ("c2", "A", 9, 0, 0, 3, False) in later
    assert run(("c1", "A", 50, 301)) == {("c1", "A", 50, 0, 0, 1, False)}
