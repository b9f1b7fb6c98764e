"""Windows, scans and joins of few long series: cut into parts and stretches, with the results of the uncut ones."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import HOUR_MS
from tidemark.operators import aggregates as ag
from tidemark.operators import backtest as bt
from tidemark.operators import features as fx
from tidemark.operators import joins as jn
from tidemark.operators import strategies as st
from tidemark.operators import windows as wn


@pytest.fixture(scope="module")
def series(spark):
    """One long symbol, one of a few rows far apart, one with holes."""
    rng = np.random.default_rng(4)
    rows = [("long", i * 1000, float(x), i) for i, x in enumerate(rng.normal(size=900))]
    rows += [("rare", i * 97_001, float(i), i) for i in range(12)]
    rows += [("holes", int(t), None if i % 17 == 3 else float(i % 29), i) for i, t in enumerate(np.sort(rng.choice(900_000, 300, replace=False)))]
    return spark.createDataFrame(rows, "symbol string, t long, x double, part int").repartition(4).cache()


def equal(a, b):
    key = lambda r: (r.symbol, r.t)
    a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert len(a) == len(b) and a
    for p, q in zip(a, b, strict=True):
        assert p.asDict().keys() == q.asDict().keys()
        for c in p.asDict():
            assert p[c] == q[c] or isinstance(p[c], float) and q[c] == pytest.approx(p[c], rel=1e-9, abs=1e-12), (p, q, c)


@pytest.mark.parametrize(("rows", "width"), [(1, 500), (40, 7_000), (64, 100_000), (10_000, 60_000)])
def test_windows_see_their_halo(series, rows, width):
    def all_(df):
        w = wn.by_symbol(df)
        x = F.col("x")
        high, low = wn.prior_extrema(x, x, 30, w)
        df = df.withColumns({"m": wn.rolling_mean(x, 12, w), "z": wn.rolling_zscore(x, 25, w), "lag": F.lag("x", 30).over(w), "lead": F.lead("x", 9).over(w), "high": high, "low": low})
        df = df.withColumn("ahead", F.sum("x").over(w.rowsBetween(1, 9)))
        return wn.efficiency(df, "x", 20, "e").withColumn("chain", wn.trailing_sum(F.col("m"), 12, 0, w))

    cut = wn.with_halo(series, 30, 9, width, rows)
    equal(all_(series), wn.own(all_(cut)))
    parts = cut.where("symbol = 'long'").groupBy(wn.PART).agg(F.count_if(wn.OWN).alias("own"), F.count("*").alias("n")).collect()
    per = max(width // 1000, 1)
    assert sum(r.own for r in parts) == 900 and all(r.own <= max(rows, 30) + per and r.n - r.own <= 39 + 2 * per for r in parts)
    assert len(parts) > 1 or rows > 900


@pytest.mark.parametrize("rows", [1, 25, 10_000])
def test_segments_and_carried_values(series, rows):
    df = series.withColumn("x", F.coalesce("x", F.lit(1.0)))
    plain = wn.segments(df, 3_000)
    inner = Window.partitionBy("symbol", "seg").orderBy("t")
    plain = plain.withColumn("__s", wn.trailing_sum(F.col("x"), 6, 0, inner))
    plain = plain.withColumn("s", F.last("__s", ignorenulls=True).over(wn.by_symbol())).drop("__s")
    equal(plain, wn.segmented_sum(df, "x", 6, "s", 3_000, 20_000, rows))


@pytest.mark.parametrize("width", [1_500, 40_000, 10**9])
def test_compounding_in_two_levels(series, width):
    df = series.withColumn("x", F.col("x") / 100)
    w = Window.partitionBy("symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("equity", F.exp(F.sum(F.log1p("x")).over(w)))
    plain = plain.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)
    equal(plain, wn.drawdown(df, "x", ["symbol"], "t", width))
    one = df.where("symbol = 'long'").withColumn("x", F.col("x") - 0.001)
    got = wn.worst_drawdown(one, "x", [], "t", width).first()
    x = np.array([r.x for r in one.orderBy("t").collect()])
    equity = np.exp(np.cumsum(np.log1p(x)))
    assert got.n == 900 and got.log_sum == pytest.approx(np.log(equity[-1])) and got.mean == pytest.approx(x.mean()) and got.deviation == pytest.approx(x.std(ddof=1))
    assert got.max_drawdown == pytest.approx((equity / np.maximum.accumulate(equity) - 1).min()) and got.hit_rate == pytest.approx((x > 0).mean())


def test_statistics_of_one_and_of_no_rows(series):
    one = ag.return_statistics(series.where("symbol = 'rare' AND t = 0").withColumn("x", F.lit(0.5)), ["symbol"], "x", "t").first()
    assert one.n == 1 and one.total_return == pytest.approx(0.5) and one.annual_volatility is None and one.sharpe is None and one.max_drawdown == 0 and one.calmar is None
    assert ag.return_statistics(series.where("t < 0"), ["symbol"], "x", "t").count() == 0
    flat = ag.return_statistics(series.where("symbol = 'long'").withColumn("x", F.lit(0.01)), [], "x", "t").first()
    assert flat.sharpe is None and flat.hit_rate == 1.0


def test_features_of_cut_series_are_those_of_whole_ones(spark, monkeypatch):
    bars = spark.sql("""SELECT s.symbol, i * 900000L AS t, p * (1 - 0.0005 * sin(i / 11)) AS open, p * 1.0005 AS high, p * 0.9995 AS low, p AS close, 1e6 + 10 * i AS quote_volume, (1e6 + 10 * i) * (0.5 + 0.1 * sin(i / 7)) AS taker_quote_volume
        FROM (SELECT i, symbol, 100 * k * exp(0.003 * sin(i / (70 + k))) AS p FROM range(0, 2400) AS r(i), VALUES ('a', 1), ('b', 2), ('c', 3) AS v(symbol, k)) s""")
    rates = spark.sql("SELECT symbol, i * 28800000L AS funding_t, i / 1e5 AS funding_rate FROM range(0, 75) AS r(i), VALUES ('a'), ('b'), ('c') AS v(symbol)")
    names = [o for b in fx.BUNDLES for o in b.outputs]

    def made():
        rows = fx.decision_rows(bars, 4, 900_000)
        return fx.Registry().compute(rows, names, {"leaders": ("a", "b"), "beta_hours": 48}, {"rates": rates}).select("symbol", "t", *names).cache()

    whole = made()
    assert whole.where("realized_volatility_168h IS NOT NULL AND residual_momentum_24h IS NOT NULL").count() > 1000
    monkeypatch.setattr(wn, "PART_ROWS", 1)
    equal(whole, made())


def test_moving_averages_of_cut_series(spark, monkeypatch):
    df = spark.range(1500).selectExpr("'a' AS symbol", f"(id + floor(id / 400) * 5) * {HOUR_MS}L AS t", "sin(id / 9) / 50 AS log_return_1h")
    whole = st.sma_ratio(df, 5, 40)
    monkeypatch.setattr(wn, "PART_ROWS", 1)
    equal(whole, st.sma_ratio(df, 5, 40))


def _asof_rows(seed, keys):
    rng = np.random.default_rng(seed)
    left = [(None if i % 41 == 0 else str(rng.choice(keys)), None if i % 37 == 0 else int(rng.integers(0, 1000)), i) for i in range(300)]
    right = [(str(rng.choice(keys)), int(rng.integers(100, 900)), float(rng.integers(0, 50))) for _ in range(60)] + [(None, 500, 7.0), (keys[0], None, 1.0)]
    return left, right


@pytest.mark.parametrize("width", [1, 70, 10_000])
@pytest.mark.parametrize("keys", [["hot"], ["a", "b", "c"]])
def test_asof_by_buckets(spark, width, keys):
    left, right = _asof_rows(len(keys), keys)
    sums = {}
    for k, t, v in right:
        if t is not None:
            sums[k, t] = sums.get((k, t), 0) + v
    want = {}
    for k, t, i in left:
        have = sorted(x for kk, x in sums if kk == k and t is not None and x <= t)
        value = sums[k, have[-1]] if have else None
        want[i] = (k, t, value, value - sums[k, have[-2]] if len(have) > 1 else None)
    lf, rf = spark.createDataFrame(left, "k string, at long, change int").withColumnRenamed("change", "i"), spark.createDataFrame(right, "k string, at long, v double")
    got = jn.asof_backward(lf, rf, "k", "at", "at", "v", width).collect()
    assert len(got) == 300 and {r.i: (r.k, r["at"], r.v, r.change) for r in got} == want
    assert jn.asof_backward(lf, rf.where("v < 0"), "k", "at", "at", "v", width).where("v IS NOT NULL").count() == 0


def test_fee_schedule_of_any_length(spark):
    """Five thousand changes of fees: each row has the fee that holds at its time; gaps are an error."""
    w = spark.range(6000).selectExpr("0 AS fold", f"id * {HOUR_MS}L AS t", "'a' AS symbol", "cast(id % 2 AS double) AS weight", "0.0 AS ret")
    spans = spark.range(5000).selectExpr(f"id * {HOUR_MS}L AS from_t", f"CASE WHEN id < 4999 THEN (id + 1) * {HOUR_MS}L END AS to_t", "(id + 1) / 1e7 AS fee")
    got = {r.t // HOUR_MS: r.allocated_fee / r.trade_weight for r in bt.positions(w, schedule=spans).where("trade_weight > 0").collect()}
    assert len(got) >= 5999 and all(f == pytest.approx(min(h + 1, 5000) / 1e7) for h, f in got.items())
    with pytest.raises(Exception, match="no fee for this time"):
        bt.positions(w, schedule=spans.where("to_t IS NOT NULL")).agg(F.sum("allocated_fee")).collect()
    with pytest.raises(Exception, match="no fee for this time"):
        bt.positions(w, schedule=spans.where("from_t > 0")).agg(F.sum("allocated_fee")).collect()


def test_similarity_is_measured_period_by_period(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(40, 4)), rng.normal(size=(40, 4))
    a[3], b[5, 1:] = 0.0, 0.0
    frame = lambda m: spark.createDataFrame([(t, f"s{j}", float(m[t, j])) for t in range(40) for j in range(4) if m[t, j] != 0 or t == 3], "t long, symbol string, weight double")
    got = bt.position_similarity(frame(a), frame(b)).first()
    cosine, same, opposite = [], [], []
    for x, y in zip(a, b, strict=True):
        if np.abs(x).sum() > 0 and np.abs(y).sum() > 0:
            low, gross = np.minimum(np.abs(x), np.abs(y)), min(np.abs(x).sum(), np.abs(y).sum())
            cosine.append(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
            same.append(low[x * y > 0].sum() / gross)
            opposite.append(low[x * y < 0].sum() / gross)
    assert got.n == 39 and got.both_active == pytest.approx(39 / 40)
    assert (got.mean_cosine, got.median_cosine) == pytest.approx((np.mean(cosine), np.median(cosine)))
    assert (got.same_direction, got.opposite_direction) == pytest.approx((np.mean(same), np.mean(opposite)))
    assert got.conflict == pytest.approx(np.mean(opposite) / (np.mean(same) + np.mean(opposite)))


@pytest.mark.parametrize("part", [1, 1 << 16])
def test_rolling_at_day_ends(spark, monkeypatch, part):
    monkeypatch.setattr(wn, "PART_ROWS", part)
    x = np.random.default_rng(8).normal(0, 0.01, 120)
    t = [h * HOUR_MS for h in range(130) if h % 13]  # an hour is missing now and then
    c = spark.createDataFrame([(a, float(b)) for a, b in zip(t, x, strict=False)], "t long, net_return double").repartition(3)
    got = {(r.t, r.window): r for r in bt.rolling_at_day_ends(c, (5, 30)).collect()}
    t = t[:120]
    ends = [i for i in range(len(t)) if i == len(t) - 1 or t[i] // 86_400_000 != t[i + 1] // 86_400_000]
    assert set(got) == {(t[i], n) for i in ends for n in (5, 30) if i >= n - 1}
    for (at, n), r in got.items():
        v = x[t.index(at) - n + 1 : t.index(at) + 1]
        sd = v.std(ddof=1) * 8760**0.5
        assert (r.total_return, r.volatility, r.sharpe) == pytest.approx((np.prod(1 + v) - 1, sd, v.mean() * 8760 / sd))


def test_netted_portfolios_pay_funding(spark):
    rows = [(k, 0.5, 0, t, "s", w, 0.01, 0.001) for k, ws in (("a", (1.0, 1.0)), ("b", (-1.0, 1.0))) for t, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "sleeve string, share double, fold int, t long, symbol string, weight double, ret double, funding_rate double")
    got = {r.t: r for r in bt.netted(df, bt.Costs(0.001, 0, 0)).collect()}
    assert (got[0].price_pnl, got[0].funding_pnl, got[0].netted_turnover, got[0].sleeve_turnover) == pytest.approx((0.0, 0.0, 0.0, 1.0))
    assert (got[1].price_pnl, got[1].funding_pnl) == pytest.approx((0.01, -0.001))
    assert got[1].netted_net == pytest.approx(0.009 - 0.001 * 2.0)


def test_views_check_roles_keys_and_registry(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 1, 1.0, 2.0), (None, 2, 1.0, 2.0)], "symbol string, t long, log_return_1h double, age double")
    assert fx.feature_view(df, ["log_return_1h"], registry=fx.Registry()).columns == ["symbol", "t", "log_return_1h"]
    for features, more, why in (
        (["age"], {"roles": {"age": "target"}}, "no features"), (["age"], {"registry": fx.Registry()}, "unknown feature"), (["t"], {}, "no features"),
        (["age", "age"], {}, "named twice"), (["none"], {}, "missing"), (["label_x"], {}, "outcomes"),
    ):
        with pytest.raises(ValueError, match=why):
            fx.feature_view(df, features, **more)
    assert tuple(fx.key_faults(df).first()) == (3, 1, 1) and tuple(fx.key_faults(df.where("t > 5")).first()) == (0, 0, 0)
