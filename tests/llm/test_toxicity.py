"""The network's gradients against differences, its windows, and held-out accuracy on the test tables."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import toxicity as tx
from tidemark.llm.common import text_buffers


def test_gradients():
    model = tx.Model(3)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    raw, at = text_buffers(pa.array(["one two three four", "five Six, one", ""]))
    bucket, grams, gat, inverse, row = tx.words_of(raw, at)
    _, first, length = tx.windows_of(row, 3)
    ids, mask = tx._gather(first, length, inverse)
    ids, mask, y = ids[:, :6], mask[:, :6].astype(np.float64), np.array([1.0, 0.0, 1.0])
    _, g = model.gradients((bucket, grams, gat), ids, mask, y)
    rng = np.random.default_rng(0)
    for name, d in g.items():
        if isinstance(d, tuple):
            full = np.zeros(model.p[name].shape)
            np.add.at(full, d[0], d[1])
            at_ = (d[0][0], 2)
        else:
            full, at_ = d, tuple(rng.integers(0, s) for s in model.p[name].shape)
        kept = model.p[name][at_]
        side = []
        for e in (1e-2, -1e-2):
            model.p[name][at_] = kept + e
            side.append(model.gradients((bucket, grams, gat), ids, mask, y)[0])
        model.p[name][at_] = kept
        assert abs((side[0] - side[1]) / 2e-2 - full[at_]) < 2e-3 + 0.02 * abs(full[at_]), name


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        owner, first, length = tx.windows_of(np.zeros(n, np.int64), 1)
        assert set().union(*(range(f, f + k) for f, k in zip(first, length, strict=True))) == set(range(n))
        assert len(first) == 1 or (np.diff(first) == tx.STRIDE).all() and (length > tx.WINDOW - tx.STRIDE).all()


def test_words():
    raw, at = text_buffers(pa.array(["Idiot!! é,idiot a", None]))
    bucket, grams, gat, inverse, row = tx.words_of(raw, at)
    assert len(bucket) == 3 and inverse[0] == inverse[2] and row.tolist() == [0] * 4 and len(grams) == gat[-1]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = tx.fit(docs, labels)
    got = {r.doc_id: r.score for r in tx.score(docs, model).collect()}
    y = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    hits = [(got[i] >= 0.7) == bool(t) for i, t in y.items()]
    caught = [got[i] >= 0.7 for i, t in y.items() if t]
    wrong = [got[i] >= 0.7 for i, t in y.items() if not t]
    print(len(y), np.mean(hits), np.mean(caught), np.mean(wrong))
    assert np.mean(caught) >= 0.9 and np.mean(wrong) <= 0.02


def test_edges(spark):
    rng = np.random.default_rng(1)
    say = lambda n: [f"w{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}" for k in rng.integers(0, 60, n)]
    rows = [(i, " ".join([*say(i % 30), *([] if i % 2 else ["VILE" + "abcd"[i % 4]]), *say(20)]), "k") for i in range(400)]
    long = " ".join(say(60_000))
    rows += [(500, None, "k"), (501, "", "k"), (502, long, "k"), (503, long + " vilea", "k"), (503, long + " vilea", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)] + [(500, None, 0), (999, 1, 0)], "doc_id long, toxic int, quality int")
    model = tx.fit(docs, labels)
    got = tx.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert all((by[i] >= 0.7) == (i % 2 == 0) for i in range(400)) and by[502] < 0.7 <= by[503] and by[500] == by[501] < 0.7
    assert {r.doc_id for r in tx.accepted(docs, labels).collect()} == {i for i in by if by[i] < 0.7}
    none = tx.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in tx.score(docs, none).collect()} == {0.0}
    assert tx.score(docs.limit(0), model).count() == 0


def test_accepted_agrees_with_scores_for_one_class(spark):
    docs = spark.createDataFrame([(i, f"some words here {i}") for i in range(6)] + [(7, None)], "doc_id long, text string")
    for y, left in ((1, 0), (0, 7)):
        labels = spark.createDataFrame([(i, y) for i in range(6)], "doc_id long, toxic int")
        scores = tx.score(docs, tx.fit(docs, labels))
        assert scores.where("score < 0.7").count() == left == tx.accepted(docs, labels).count()
