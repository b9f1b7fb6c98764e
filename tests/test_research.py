"""Golden numbers of a synthetic panel, and what SQL does not express against plain NumPy."""

import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import features as fx
from tidemark.operators import joins as jn
from tidemark.operators import portfolio as pf
from tidemark.operators import registry as rg
from tidemark.operators import strategies as st
from tidemark.operators import validation as va
from tidemark.sources import files, wire

START, HOUR = 1_767_225_600_000, 3_600_000


def panel(spark, days=11):
    rows = []
    for h in range(days * 24):
        vol = 0.012 + 0.002 * math.sin(h / 24)
        for s, name in enumerate(("BTCUSDT", "ETHUSDT", "SOLUSDT")):
            phase = math.sin(h / 9 + s)
            r = 0.002 * phase
            rows.append((name, START + h * HOUR + HOUR - 1, r, 2 * r + 0.0001 * s, 4 * r - 0.0001 * s, vol * (1 + 0.1 * s), 0.8 + 0.25 * s, 0.0015 * phase - 0.0002 * s, 1e-4 * (s + 1) if h % 8 == 7 else 0.0, 1e8, 0.0012 * phase))
    return spark.createDataFrame(rows, "symbol string, t long, residual_momentum_1h double, residual_momentum_4h double, residual_momentum_24h double, vol double, beta double, ret double, funding_rate double, volume double, outcome double")


def test_golden_backtest(spark):
    """The published numbers of this panel: 3 folds, 72 periods."""
    p = panel(spark)
    folds = bt.folds(p.select("t"), 7 * 24, 24, 1)
    test = jn.with_folds(st.residual_momentum(p), folds, "t", "test_start", "test_end")
    w = pf.neutral_long_short(test, ["fold"], band=0.1).cache()
    pos = bt.positions(w, bt.Costs(0.0005, 1.0, 1.0))
    c = bt.oos_equity(bt.curve(pos))
    m = bt.curve_metrics(c, []).first()
    assert folds.count() == 3 and m.n == 72
    want = {
        "total_return": 0.022538662281505806, "sharpe": 112.98691088898067, "annual_return": 14.055716234151848, "annual_volatility": 0.024006865718611037, "turnover": 7.5, "annual_turnover": 912.5,
        "price_pnl": 0.02711920491237614, "funding_pnl": 5.000000000000002e-05, "trading_fees": 0.00375, "spread_cost": 0.000375, "slippage_cost": 0.00075, "net_pnl": 0.022294204912376138, "mean_gross": 0.5, "max_beta": 0.125, "max_participation": 3.75e-05, "hit_rate": 0.9027777777777778,
    }
    for k, v in want.items():
        assert m[k] == pytest.approx(v, rel=1e-9), k
    assert m.max_drawdown == pytest.approx(-0.0003323375272166196, rel=1e-9) and abs(m.mean_net) < 1e-15 and m.accounting_error < 1e-15
    assert c.orderBy(F.desc("t")).first().oos_equity == pytest.approx(1 + want["total_return"])
    schedule = spark.createDataFrame([(0, START, 9.0), (START, None, 0.0005)], "from_t long, to_t long, fee double")
    assert bt.curve(bt.positions(w, schedule=schedule)).agg(F.sum("trading_fees")).first()[0] == pytest.approx(0.00375)
    s = {r.scenario: r.total_return for r in bt.stress(w, [1.0, 2.0], bt.Costs(), {"same": w}).collect()}
    assert s["cost_x1"] == pytest.approx(want["total_return"]) == s["same"] and s["cost_x2"] < s["cost_x1"] and set(s) == {"cost_x1", "cost_x2", "delay_1", "same"}
    assert {r.scenario for r in bt.stress(w, [1.0], full=False).collect()} == {"cost_x1"}
    # One neutral pair: gross times the raw pair orthogonal to ones and betas, as a pseudo-inverse has it.
    first = {r.symbol: r for r in w.where(F.col("t") == w.agg(F.min("t")).first()[0]).collect()}
    raw = np.array([0.0] * 3)
    names = sorted(first)
    score = [first[n].score for n in names]
    raw[int(np.argmax(score))], raw[int(np.argmin(score))] = 1, -1
    a = np.vstack([np.ones(3), [first[n].beta for n in names]])
    x = raw - a.T @ np.linalg.pinv(a @ a.T) @ (a @ raw)
    x = raw if np.abs(x).sum() <= 1e-12 else x
    x = x / np.abs(x).sum()
    x *= min(0.5, 0.15 / math.sqrt(sum((x[i] * first[n].vol) ** 2 * 365 for i, n in enumerate(names))))
    x *= min(1, 0.25 / np.abs(x).max())
    assert np.allclose(x, [first[n].weight for n in names])


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(3)
    times, symbols, names = 60, 5, st.RIDGE
    x = rng.normal(size=(times, symbols, len(names)))
    y = 0.3 * x[:, :, 0] - 0.2 * x[:, :, 3] + rng.normal(size=(times, symbols)) * rng.choice([0.1, 9], size=(times, symbols))
    rows = [(0, f"s{j}", i, *map(float, x[i, j]), float(y[i, j])) for i in range(times) for j in range(symbols)]
    df = spark.createDataFrame(rows, ["fold", "symbol", "t", *names, "future_residual_return_1h"])
    got = {(r.t, r.symbol): r.score for r in st.linear_cross_sectional(df.where("t < 40"), df.where("t >= 40"), 0.5).collect()}
    z = lambda a: (a - a.mean(axis=1, keepdims=True)) / a.std(axis=1, keepdims=True)
    design = np.stack([z(x[:, :, k]) for k in range(len(names))], axis=2)
    c = y[:40] - y[:40].mean(axis=1, keepdims=True)
    target = np.clip(c / c.std(), -5, 5).ravel()
    d = design[:40].reshape(-1, len(names))
    beta = np.linalg.solve(d.T @ d / len(d) + 0.5 * np.eye(len(names)), d.T @ target / len(d))
    want = z(design[40:] @ beta)
    assert all(got[i + 40, f"s{j}"] == pytest.approx(want[i, j], abs=1e-9) for i in range(20) for j in range(symbols))


def test_pair_spread_weights(spark):
    legs = spark.createDataFrame([(0, 1, "b", "b", 1.0), (0, 1, "b", "a", -0.8), (0, 1, "c", "c", -1.0), (0, 1, "c", "a", 1.5), (0, 2, "b", "b", 0.0), (0, 2, "b", "a", 0.0)], "fold int, t long, other string, symbol string, raw double")
    market = spark.createDataFrame([(0, t, s, v) for t in (1, 2) for s, v in (("a", 0.01), ("b", 0.02), ("c", 0.03))], "fold int, t long, symbol string, vol double")
    got = {(r.t, r.symbol): r for r in pf.pair_spread(legs, market, ["fold"]).collect()}
    raw = np.array([0.7, 1.0, -1.0])
    n = raw / np.abs(raw).sum()
    scale = min(0.5, 0.15 / math.sqrt(((n * [0.01, 0.02, 0.03]) ** 2).sum() * 365)) / np.abs(raw).sum()
    scale *= min(1, 0.25 / (np.abs(raw) * scale).max())
    assert np.allclose([got[1, s].weight for s in "abc"], raw * scale) and all(got[2, s].weight == 0 for s in "abc")
    assert got[1, "a"].pair_weights == pytest.approx({"b": -0.8 * scale, "c": 1.5 * scale})
    with pytest.raises(Exception, match="too many active pairs"):
        pf.pair_spread(legs, market, ["fold"], most_pairs=1).collect()


def test_validation_against_numpy(spark):
    assert va.deflated_sharpe(1.2, 500, -0.2, 3.5, [0.1, 0.3, 0.6, 0.9, 1.2], 252) == pytest.approx((0.8251207512775627, 0.5293290554064866))
    rng = np.random.default_rng(1)
    r = rng.normal(0.001, 0.01, 130)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(r)], "t long, r double").repartition(4)
    g, out = np.random.default_rng(42), []
    for _ in range(60):
        starts = g.integers(0, 107, size=6)
        out.append(np.prod(1 + np.concatenate([r[s : s + 24] for s in starts])[:130]) - 1)
    got = va.block_bootstrap(df, "r", "t", 60, 24, 42, width=30).orderBy("sample").collect()
    assert np.allclose([x.total_return for x in got], out)
    b = va.bootstrap_summary(va.block_bootstrap(df, "r", "t", 60)).first()
    assert (b.p05, b.p50, b.p95) == pytest.approx(tuple(np.quantile(out, [0.05, 0.5, 0.95]))) and b.probability_positive == pytest.approx(np.mean(np.array(out) > 0))
    t = np.arange(163.0)
    m = np.column_stack([np.sin(t / (3 + i)) * 0.01 + (i - 4) * 0.00001 for i in range(8)])
    trials = spark.createDataFrame([(f"t{j}", i * 7, float(m[i, j])) for i in range(163) for j in range(8)], "trial string, t long, net_return double")
    from itertools import combinations

    parts, logits = np.array_split(np.arange(163), 8), []
    sharpe = lambda x: x.mean(axis=0) / x.std(axis=0, ddof=1)
    for inside in combinations(range(8), 4):
        if 0 in inside:
            own = sharpe(m[np.concatenate([parts[i] for i in inside])])
            other = sharpe(m[np.concatenate([parts[i] for i in range(8) if i not in inside])])
            place = int(np.flatnonzero(np.lexsort((np.arange(8), -other)) == int(np.argmax(own)))[0])
            share = (8 - place) / 9
            logits.append(math.log(share / (1 - share)))
    p = va.overfitting_probability(trials, width=100).first()
    assert p.combinations == 35 and p.trials == 8 and p.probability == pytest.approx(np.mean(np.array(logits) <= 0)) and p.reason == ""
    for few, segments, why in ((trials.where("trial <> 't3'"), 8, "trials"), (trials.where("t < 105"), 8, "times"), (trials, 6, "segments"), (trials, 9, "segments")):
        none = va.overfitting_probability(few, segments=segments, width=100).first()
        assert none.probability is None and none.reason == why
    short = va.block_bootstrap(df.where("t < 10"), "r", "t", 3).collect()
    assert [x.total_return for x in short] == pytest.approx([np.prod(1 + r[:10]) - 1] * 3)
    assert va.block_bootstrap(df.where("t < 0"), "r", "t", 3).count() == 0
    d = va.deflated_sharpe_of(trials, periods_a_year=252).first()
    year = math.sqrt(252)
    sharpes = sharpe(m) * year
    best = int(np.argmax(sharpes))
    z = (m[:, best] - m[:, best].mean()) / m[:, best].std()
    want = va.deflated_sharpe(sharpes[best], 163, (z**3).mean(), (z**4).mean(), sharpes.tolist(), 252)
    assert d.trial == f"t{best}" and (d.probability, d.benchmark_sharpe) == pytest.approx(want)


def test_rules_over_facts(spark):
    rules = (va.Rule("a", "x", "above", 1), va.Rule("b", "x", "at_most", 2), va.Rule("c", "y", "at_least", 0.5), va.Rule("d", "z", "stated"))
    facts = [("p", "x", 1.5), ("p", "y", 0.5), ("p", "z", None), ("q", "x", 1.0), ("q", "y", float("nan")), ("r", "x", 2.5), ("r", "y", None), ("r", "z", 0.1)]
    got = {(x.trial, x.rule): (x.passed, x.all_passed) for x in va.judged(spark.createDataFrame(facts, "trial string, fact string, value double"), rules).collect()}
    want = {"p": (True, True, True, True), "q": (False, True, False, False), "r": (True, False, False, True)}
    assert got == {(t, r): (ok, all(w)) for t, w in want.items() for r, ok in zip("abcd", w, strict=True)}


def test_campaign_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.01, (200, 9)) + np.linspace(-0.002, 0.002, 9)
    rows = spark.createDataFrame([(f"t{j}", i % 4, i * 3_600_000, float(x[i, j])) for i in range(200) for j in range(9)], "trial string, fold int, t long, net_return double")
    p = spark.createDataFrame([(f"t{j}", float(j // 3), float(j % 3)) for j in range(9)], "trial string, a double, b double")
    r = va.campaign_robustness(rows, p, ["a", "b"]).first()
    sharpe = x.mean(axis=0) / x.std(axis=0, ddof=1) * math.sqrt(8760)
    best = int(sharpe.argmax())
    z = (x[:, best] - x[:, best].mean()) / x[:, best].std()
    want = va.deflated_sharpe(sharpe[best], 200, (z**3).mean(), (z**4).mean(), sharpe.tolist(), 8760)
    assert r.best == f"t{best}" and r.trials == r.distinct_parameters == 9 and (r.deflated_sharpe, r.benchmark_sharpe) == pytest.approx(want)
    assert r.independent_trials == pytest.approx(81 / (np.corrcoef(x.T) ** 2).sum()) and 0 <= r.overfitting <= 1 and r.overfitting_reason == ""
    assert (r.sharpe_minimum, r.sharpe_median, r.sharpe_maximum) == pytest.approx(tuple(np.quantile(sharpe, [0, 0.5, 1])))
    facts = {(f.trial, f.fact): f.value for f in va.campaign_facts(va.campaign_robustness(rows, p, ["a", "b"])).collect()}
    assert set(facts) == {(r.best, n) for n in ("neighbours_positive", "deflated_sharpe", "overfitting")} and facts[r.best, "deflated_sharpe"] == r.deflated_sharpe
    champion = spark.createDataFrame([(f"t{best}",)], "trial string")
    for b in va.beside_champion(rows, champion).collect():
        y = x[:, int(b.trial[1:])]
        mix = 0.8 * x[:, best] + 0.2 * y * x[:, best].std() / y.std()
        assert b.correlation == pytest.approx(np.corrcoef(x[:, best], y)[0, 1])
        assert b.sharpe_increment == pytest.approx((mix.mean() / mix.std(ddof=1)) * math.sqrt(8760) - sharpe[best])
    positions = rows.selectExpr("trial", "if(fold > 1, 'a', 'b') AS symbol", "t", "net_return AS net_contribution")
    stressed = spark.createDataFrame([(f"t{j}", "delay_1", 0.1) for j in range(9)], "trial string, scenario string, total_return double")
    f = {(v.trial, v.fact): v.value for v in va.trial_facts(rows, positions, stressed, F.floor(F.col("t") / 86_400_000)).collect()}
    one = x[:, 4]
    folds = [np.prod(1 + one[np.arange(200) % 4 == k]) - 1 for k in range(4)]
    days = np.abs([one[i : i + 24].sum() for i in range(0, 200, 24)])
    parts = np.abs([one[np.arange(200) % 4 > 1].sum(), one[np.arange(200) % 4 <= 1].sum()])
    assert f["t4", "folds_won"] == sum(v > 0 for v in folds) and f["t4", "worst_fold"] == pytest.approx(min(folds)) and f["t4", "folds"] == 4
    assert f["t4", "span_share"] == pytest.approx(days.max() / days.sum()) and f["t4", "symbol_share"] == pytest.approx(parts.max() / parts.sum())
    assert f["t4", "place"] == 1 + sorted(range(9), key=lambda j: -sharpe[j]).index(4) and f["t4", "stress:delay_1"] == 0.1


def test_trade_costs_and_pairs(spark):
    """Costs of trades add up to those of the positions; so do pairs' turnover and P&L."""
    rng = random.Random(5)
    rows = [(f, s, t, rng.choice([0.0, 0.3, -0.2, 0.1]), rng.uniform(-0.01, 0.01), rng.uniform(-1e-4, 1e-4)) for f in (0, 1) for s in "ab" for t in range(f * 40, f * 40 + 40)]
    w = spark.createDataFrame(rows, "fold int, symbol string, t long, weight double, ret double, funding_rate double")
    p = bt.positions(w)
    total = p.agg(F.sum("net_contribution").alias("net"), F.sum("trade_weight").alias("turnover"), F.sum(F.col("allocated_fee") + F.col("allocated_spread") + F.col("allocated_slippage")).alias("cost")).first()
    e = bt.trade_events(p)
    got = e.agg(F.sum("net_return").alias("net"), F.sum("turnover").alias("turnover"), F.sum("explicit_cost").alias("cost")).first()
    assert (got.net, got.turnover, got.cost) == pytest.approx((total.net, total.turnover, total.cost))
    assert {r.exit_reason for r in e.collect()} == {"fold_close", "signal_exit", "direction_flip"}
    pairs = w.select("fold", "t", "symbol", F.lit("p").alias("other"), F.col("weight").alias("pair_weight"))
    d = bt.pair_diagnostics(p, pairs).agg(F.sum("net_pnl").alias("net"), F.sum("turnover").alias("turnover")).first()
    assert (d.net, d.turnover) == pytest.approx((total.net, total.turnover))
    with pytest.raises(Exception, match="non-positive"):
        bt.curve(bt.positions(w.withColumn("ret", F.lit(-9.0)).withColumn("weight", F.lit(0.5)))).collect()


def test_feature_registry():
    r = fx.Registry()
    names = [b.name for b in r.plan(["flow_price_agreement_1h"])]
    assert names[-1] == "flow" and names.index("returns_momentum") < names.index("volatility") < names.index("flow")
    assert r.checksum(["quote_volume_1h", "rolling_beta"]) == r.checksum(["rolling_beta", "quote_volume_1h"]) != r.checksum(["rolling_beta"])
    with pytest.raises(ValueError):
        r.register(fx.Bundle("volume", "v2", lambda d: d, ("quote_volume_1h",)))
    with pytest.raises(ValueError):
        r.register(fx.Bundle("mine", "v1", lambda d: d, ("quote_volume_1h",)))
    with pytest.raises(ValueError):
        r.plan(["nothing"])
    before = r.checksum(["quote_volume_1h"])
    r.register(fx.Bundle("volume", "v2", lambda d: d, ("quote_volume_1h",)), replace=True)
    assert r.checksum(["quote_volume_1h"]) != before
    assert len([o for b in fx.BUNDLES for o in b.outputs]) == 39
    with pytest.raises(ValueError):
        fx.feature_view(None, ["future_return_1h"])


def test_wire_messages(spark):
    kline = {"t": 1, "T": 2, "i": "1m", "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "3", "q": "4", "n": 5, "V": "1", "Q": "2", "x": True}
    good = [
        ("btcusdt@bookTicker", {"e": "bookTicker", "s": "BTCUSDT", "E": 10, "u": 7, "b": "1.5", "B": "2", "a": "1.6", "A": "3", "T": 9}),
        ("btcusdt@aggTrade", {"e": "aggTrade", "s": "BTCUSDT", "E": 11, "a": 8, "p": "1.55", "q": "2", "f": 1, "l": 2, "T": 9, "m": True}),
        ("ethusdt@markPrice@1s", {"e": "markPriceUpdate", "s": "ETHUSDT", "E": 12, "p": "1", "i": "1", "P": "1", "r": "0.0001", "T": 99}),
        ("ethusdt@kline_1m", {"e": "kline", "s": "ETHUSDT", "E": 13, "k": kline}),
    ]
    bad = [
        ("symbol", "btcusdt@aggTrade", good[1][1] | {"s": "ETHUSDT"}), ("event type", "btcusdt@aggTrade", good[1][1] | {"e": "trade"}), ("field a", "btcusdt@aggTrade", good[1][1] | {"a": True}), ("field m", "btcusdt@aggTrade", good[1][1] | {"m": 1}),
        ("field p", "btcusdt@aggTrade", good[1][1] | {"p": "NaN"}), ("field p", "btcusdt@aggTrade", good[1][1] | {"p": 1.5}), ("field q", "btcusdt@aggTrade", good[1][1] | {"q": "x"}), ("field E", "btcusdt@aggTrade", good[1][1] | {"E": "11"}),
        ("interval", "ethusdt@kline_1m", good[3][1] | {"k": kline | {"i": "5m"}}), ("field k.n", "ethusdt@kline_1m", good[3][1] | {"k": kline | {"n": None}}), ("unsupported stream", "btcusdt@depth", good[1][1]), ("shutdown", "btcusdt@aggTrade", {"e": "serverShutdown"}),
    ]
    texts = [json.dumps({"stream": s, "data": d}) for s, d in good] + [json.dumps({"stream": s, "data": d}) for _, s, d in bad] + ["{not json", '{"stream": "x@aggTrade"}', '{"result": null, "id": 3}']
    parsed = wire.parse(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "n long, value string"), passed=("n",)).cache()
    reasons = {r.n: r.reject_reason for r in parsed.collect()}
    assert [reasons[i] for i in range(4)] == [None] * 4 and [reasons[4 + i] for i in range(len(bad))] == [b[0] for b in bad]
    assert reasons[4 + len(bad)] == reasons[5 + len(bad)] == "not a message" and 6 + len(bad) not in reasons
    book, trade = wire.of_kind(parsed, "book_ticker").first(), wire.of_kind(parsed, "aggregate_trades").first()
    assert (book.bid_price, book.ask_qty, book.update_id, book.bid_price_str) == (1.5, 3.0, 7, "1.5") and (trade.price, trade.buyer_is_maker, trade.symbol) == (1.55, True, "BTCUSDT")
    assert wire.of_kind(parsed, "mark_price").first().funding_rate == 0.0001 and wire.of_kind(parsed, "kline_1m").first().trade_count == 5
    counts = {(r.kind, r.symbol): (r.messages, r.rejected) for r in wire.message_counts(parsed).collect()}
    assert counts["aggregate_trades", "BTCUSDT"] == (10, 9)
    rows = spark.createDataFrame([("a", "S", 1000, 1.0, 1.0, 1, 2, 2_000_000_000), ("b", "S", 2000, -1.0, 1.0, 1, 2, 2_500_000_000), ("b", "S", 3000, 1.0, 1.0, 3, 2, 9_000_000_000)], "event_id string, symbol string, event_time_ms long, price double, quantity double, first_trade_id long, last_trade_id long, got long")
    a = wire.stream_audit(rows, "aggregate_trades", "got", 5).first()
    assert (a.n_rows, a.duplicates, a.invalid, a.latency_p50, a.staleness_max) == (3, 1, 2, 1005.0, 6.5)


def test_instruments(spark):
    doc = {"serverTime": 5, "symbols": [{"symbol": "A", "status": "TRADING", "contractType": "PERPETUAL", "quoteAsset": "USDT", "filters": [{"filterType": "PRICE_FILTER", "tickSize": "0.10"}, {"filterType": "LOT_SIZE", "stepSize": "0.001", "minQty": "0.01"}, {"filterType": "NOTIONAL", "minNotional": "7"}]}, {"symbol": "B", "filters": [{"filterType": "MIN_NOTIONAL", "notional": "5"}]}]}
    got = {r.symbol: r for r in wire.instruments(spark.createDataFrame([(json.dumps(doc),)], "value string")).collect()}
    assert float(got["A"].tick_size) == 0.1 and float(got["A"].min_notional) == 7 and float(got["B"].min_notional) == 5 and got["B"].tick_size is None and got["A"].valid_from_ms == 5


def test_files(spark, tmp_path):
    bar = "1000,1,2,0.5,1.5,3,1999,4,5,1,2,0"
    (tmp_path / "a.csv").write_text("open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore\n" + bar + "\n")
    (tmp_path / "b.csv").write_text(bar.replace("1000", "2000") + "\n")
    got = files.read_bar_csv(spark, str(tmp_path / "*.csv"), "S").orderBy("t").collect()
    assert [(r.t, r.close, r.trades) for r in got] == [(1000, 1.5, 5), (2000, 1.5, 5)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.csv").write_text(bar + ",9\n")
    with pytest.raises(Exception, match="12 fields"):
        files.read_bar_csv(spark, str(tmp_path / "c"), "S").collect()
    d = tmp_path / "zip"
    d.mkdir()
    for name, members in (("good", {"a.csv": "x\ny"}), ("two", {"a.csv": "x", "b.csv": "y"}), ("folder", {"../a.csv": "x"}), ("kind", {"a.txt": "x"}), ("large", {"a.csv": "z" * 2000})):
        with zipfile.ZipFile(d / f"{name}.zip", "w") as z:
            for m, text in members.items():
                z.writestr(m, text)
    (d / "broken.zip").write_bytes(b"no archive")
    out = files.extract_archives(spark, str(d), 1000).collect()
    by = {}
    for r in out:
        by.setdefault(r.archive.rsplit("/", 1)[1], []).append((r.line, r.fault))
    assert by["good.zip"] == [("x", None), ("y", None)] and by["large.zip"] == [(None, "too large")] and by["broken.zip"][0][1] == "BadZipFile"
    assert by["two.zip"][0][1] == by["folder.zip"][0][1] == "not one flat file" and by["kind.zip"][0][1] == "not a csv file"
    df = spark.createDataFrame([("S", 1, 1.0), ("T", 2, 2.0), ("S", 9, 3.0)], "symbol string, t long, x double")
    m = files.persist_dataset(df, str(tmp_path / "set"), {"features": ["x"]})
    assert m["n_rows"] == 3 and files.persist_dataset(df, str(tmp_path / "set"), {"features": ["x"]}) == m
    with pytest.raises(ValueError):
        files.persist_dataset(df, str(tmp_path / "set"), {"features": ["y"]})
    stored = str(tmp_path / "set" / "data")
    assert files.describe(spark, stored)["n_rows"] == 3
    b = files.bounded(spark.read.parquet(stored), ["S"], 0, 5)
    assert [r.x for r in b.collect()] == [1.0] and "In(symbol" in (plan := b._jdf.queryExecution().toString()) or "EqualTo(symbol" in plan
    assert files.stream_views(spark, {"trades": [stored], "none": []}, "v_") == ["v_trades"] and spark.table("v_trades").count() == 3
    files.stream_views(spark, {"trades": []}, "v_")
    assert not spark.catalog.tableExists("v_trades")
    manifest = spark.createDataFrame([("p1", "bars", "OK", 0, 10), ("p2", "bars", "BAD", 0, 10), ("p3", "bars", "OK", 20, 30)], "path string, dataset string, status string, start_t long, end_t long")
    assert rg.manifest_files(manifest, "bars", ("OK",), 5, 15) == ["p1"]


def test_small_joins(spark):
    p = spark.createDataFrame([(1, "a", 1.0, True, None), (1, "b", 2.0, False, True), (2, "a", 3.0, True, True)], "t long, symbol string, x double, is_available boolean, quality_ok boolean")
    got = {(r.t, r.symbol): r.reason for r in jn.dense_panel(p, ["a", "b"]).collect()}
    assert got == {(1, "a"): "quality_ok", (1, "b"): "is_available", (2, "a"): None, (2, "b"): "missing_panel_row"}
    a = spark.createDataFrame([(i, "s", float(i % 7), i < 40) for i in range(60)], "t long, symbol string, x double, ok boolean")
    c = jn.masked_correlation(a, a.withColumn("x", -2 * F.col("x")), "x", "ok").first()
    assert c.n == 40 and c.correlation == pytest.approx(-1)
    trades = spark.createDataFrame([("s", 5), ("z", 5)], "symbol string, entry long")
    got = {r.symbol: r.f for r in jn.with_features(trades, spark.createDataFrame([("s", 5, 1.5)], "symbol string, execution_time_ms long, f double")).collect()}
    assert got == {"s": 1.5, "z": None}
    bad = rg.bad_transitions(spark.createDataFrame([("NEW", "RUN"), ("RUN", "NEW"), (None, "RUN")], "from_status string, to_status string"), [("NEW", "RUN")])
    assert {(r.from_status, r.to_status) for r in bad.collect()} == {("RUN", "NEW"), (None, "RUN")}
    e = spark.createDataFrame([("e1", "h"), ("e2", "h"), ("e3", "g")], "experiment_id string, compatibility string")
    runs = spark.createDataFrame([("e1", "r1", 1, "SUCCEEDED"), ("e1", "r2", 2, "SUCCEEDED"), ("e1", "r3", 3, "FAILED"), ("e2", "r4", 1, "SUCCEEDED")], "experiment_id string, run_id string, attempt int, status string")
    m = spark.createDataFrame([("r2", "sharpe", 1.0), ("r2", "annual_return", 0.2), ("r2", "max_drawdown", -0.1), ("r4", "sharpe", 2.0)], "run_id string, name string, value double")
    got = [(r.experiment_id, r.run_id, r.calmar, r.peers) for r in rg.catalogue(e, runs, m).collect()]
    assert got == [("e2", "r4", None, 2), ("e1", "r2", 2.0, 2), ("e3", None, None, 1)]


def test_blend_means(spark):
    x = np.random.default_rng(2).normal(size=(50, 3))
    df = spark.createDataFrame([(*map(float, r),) for r in x] + [(None, 1.0, 1.0)], "a double, b double, c double").repartition(3)
    w = [[0.5, 0.5, 0.0], [0.0, -1.0, 2.0]]
    got = {r.trial: r.mean_abs for r in fx.blend_means(df, ["a", "b", "c"], w).collect()}
    assert [got[0], got[1]] == pytest.approx(np.abs(x @ np.array(w).T).mean(axis=0).tolist())
