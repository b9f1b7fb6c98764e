"""Correlations, spectra and metrics by grain against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import grains as gr
from tidemark.operators import spectra as sp


@pytest.mark.parametrize("width", [7, 50, 10_000])
def test_masked_correlations(spark, width):
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 1.0, (200, 5))
    x[:, 1] += x[:, 0] - 1e6
    x[:, 4] = 3.0  # without spread
    mask = rng.random((200, 5)) < 0.8
    mask[20:, 3] = False  # too few
    rows = [(f"s{j}", i, float(x[i, j]), bool(mask[i, j])) for i in range(200) for j in range(5)] + [("s0", 500, None, True), ("s1", 500, float("nan"), True), ("s0", 501, 1.0, None)]
    df = spark.createDataFrame(rows, "symbol string, t long, x double, ok boolean").repartition(3)
    got = {(r.left_id, r.right_id): r for r in sp.masked_correlations(df, "symbol", "t", "x", "ok", width=width).collect()}
    assert len(got) == 25
    for i in range(5):
        for j in range(5):
            both = mask[:, i] & mask[:, j]
            r = got[f"s{i}", f"s{j}"]
            assert r.n == both.sum()
            if both.sum() < 30 or 4 in (i, j):
                assert r.correlation is None
            else:
                assert r.correlation == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert sp.masked_correlations(df.where("t < 0"), "symbol", "t", "x", "ok").count() == 0


def test_spectrum(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 3))
    x = np.column_stack([a, a[:, 0] + a[:, 1], -a[:, 2]])  # rank 3
    c = np.corrcoef(x.T)
    rows = [("g", f"s{i}", f"s{j}", float(c[i, j])) for i in range(5) for j in range(5)] + [("h", "p", "p", 1.0), ("h", "p", "q", None), ("h", "q", "p", None), ("h", "q", "q", 1.0), ("one", "p", "p", 1.0)]
    df = spark.createDataFrame(rows, "k string, left_id string, right_id string, correlation double")
    got = {r.k: r for r in sp.spectrum(df, ["k"], tolerance=1e-9).collect()}
    assert got["g"].eigenvalues == pytest.approx(np.linalg.eigvalsh(c)[::-1], abs=1e-9) and (got["g"].n, got["g"].rank) == (5, 3)
    assert got["g"].effective_count == pytest.approx(25 / (c**2).sum()) and (got["h"].eigenvalues, got["h"].rank, got["h"].effective_count) == ([], None, None)
    assert (got["one"].rank, got["one"].effective_count) == (1, 1.0)
    assert sp.spectrum(df.where("k = 'g'"), []).first().n == 5


@pytest.mark.parametrize("width", [11, 10_000])
def test_metrics_by_grains(spark, width):
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 50 == 7 else float(v), None if i % 9 == 0 else "abc"[i % 3], float(i)) for i, v in enumerate(rng.normal(0.001, 0.02, 230))]
    df = spark.createDataFrame(rows, "t long, r double, k string, fee double").repartition(3)
    got = {(m.grain, m.value): m for m in gr.metrics_by_grains(df, {"all": F.lit("all"), "k": F.col("k"), "half": F.col("t") % 2}, "r", ["t"], ("fee",), width=width).collect()}
    assert len(got) == 1 + 4 + 2
    for (grain, value), m in got.items():
        mine = [x for x in rows if x[1] is not None and (grain == "all" or (grain == "k" and x[2] == value) or (grain == "half" and str(x[0] % 2) == value))]
        v = np.array([x[1] for x in mine])
        e = np.cumprod(1 + v)
        assert m.n == len(v) and m.total_return == pytest.approx(e[-1] - 1) and m.deviation == pytest.approx(v.std(ddof=1)) and m.hit_rate == pytest.approx((v > 0).mean())
        assert m.max_drawdown == pytest.approx((e / np.maximum.accumulate(e) - 1).min()) and m.fee == sum(x[3] for x in mine) and m.sharpe == pytest.approx(v.mean() / v.std(ddof=1) * 8760**0.5)
