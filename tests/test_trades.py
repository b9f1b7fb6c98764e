"""Metrics of closed trades, statistics of legs and pairs against NumPy, and their edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import HOUR_MS
from tidemark.operators import backtest as bt
from tidemark.operators import trades as tr

START = 1_704_067_200_000  # 2024-01-01


@pytest.fixture(scope="module")
def book(spark):
    rng = random.Random(8)
    rows = [(f, s, START + (f * 500 + t) * HOUR_MS, rng.choice([0.0, 0.3, -0.2, 0.1]), rng.uniform(-0.01, 0.01), rng.uniform(-1e-4, 1e-4)) for f in (0, 1, 2) for s in "abc" for t in range(40)]
    return spark.createDataFrame(rows, "fold int, symbol string, t long, weight double, ret double, funding_rate double").repartition(3)


def test_trade_metrics(spark, book):
    events = bt.trade_events(bt.positions(book))
    rows = events.collect()
    got = {(r.scope, r.group): r for r in tr.trade_metrics(events, tr.trade_grains(F.concat(F.lit("by "), F.col("symbol")))).collect()}
    month = lambda r: str(np.datetime64(r.entry, "ms"))[:7]
    groups = {("overall", "all"): rows}
    for r in rows:
        for key in (("symbol", r.symbol), ("side", "LONG" if r.side > 0 else "SHORT"), ("month", month(r)), ("hour_utc", str(r.entry // HOUR_MS % 24)), ("entry_reason", f"by {r.symbol}")):
            groups.setdefault(key, []).append(r)
    assert set(got) == set(groups) and len({k for k in groups if k[0] == "month"}) > 1
    for key, mine in groups.items():
        g, net, hours = got[key], np.array([r.net_return for r in mine]), np.array([(r.exit - r.entry) / HOUR_MS for r in mine])
        gross, moved = sum(r.price_return + r.funding_return for r in mine), sum(r.turnover for r in mine)
        assert g.completed_trades == g.entries == g.exits == len(mine)
        assert g.direction_flips == (sum(r.exit_reason == "direction_flip" for r in mine) if key[0] == "overall" else 0)
        assert (g.holding_hours_mean, g.holding_hours_median, g.holding_hours_p10, g.holding_hours_p90) == pytest.approx((hours.mean(), np.median(hours), np.quantile(hours, 0.1), np.quantile(hours, 0.9)))
        assert (g.win_rate, g.payoff_mean, g.payoff_median) == pytest.approx(((net > 0).mean(), net.mean(), np.median(net)))
        assert g.profit_factor == pytest.approx(net[net > 0].sum() / max(-net[net < 0].sum(), 1e-15))
        assert (g.gross_pnl, g.net_pnl, g.turnover) == pytest.approx((gross, net.sum(), moved))
        assert (g.gross_edge_bps_per_turnover, g.net_edge_bps_per_turnover) == pytest.approx((1e4 * gross / moved, 1e4 * net.sum() / moved))
    assert got["overall", "all"].direction_flips > 0


def test_trade_metrics_without_trades(spark, book):
    events = bt.trade_events(bt.positions(book.withColumn("weight", F.lit(0.0))))
    (r,) = tr.trade_metrics(events).collect()
    assert (r.scope, r.group, r.completed_trades, r.turnover, r.profit_factor, r.holding_hours_median) == ("overall", "all", 0, 0.0, 0.0, 0.0)
    none = tr.trade_metrics(bt.trade_events(bt.positions(book)), {"desk": F.lit(None).cast("string")}).collect()
    assert {(r.scope, r.group) for r in none} == {("overall", "all"), ("desk", "")}


@pytest.mark.parametrize("by", [("fold",), ()])
def test_leg_statistics(spark, book, by):
    legs = bt.trade_legs(book)
    got = {r.fold if by else None: r for r in tr.leg_statistics(legs, book, by).collect()}
    rows = legs.collect()
    assert set(got) == ({0, 1, 2} if by else {None})
    for key, g in got.items():
        mine = [r for r in rows if not by or r.fold == key]
        size, times = np.array([r["size"] for r in mine]), np.array(sorted({r.t for r in mine}))
        n = 40 if by else 120
        assert (g.periods, g.rebalance_events, g.trade_legs) == (n, len(times), len(mine))
        assert [g[name] for name in tr.LEG_COUNTS.values()] == [sum(r.kind == k for r in mine) for k in tr.LEG_COUNTS]
        assert (g.traded_weight, g.mean_weight, g.median_weight, g.p90_weight, g.maximum_weight) == pytest.approx((size.sum(), size.mean(), np.median(size), np.quantile(size, 0.9), size.max()))
        assert g.mean_hours_between == pytest.approx(np.diff(times).mean() / HOUR_MS) and g.idle_fraction == pytest.approx(1 - len(times) / n)
        assert g.long_weight == pytest.approx(sum(r["size"] for r in mine if r.bought)) and g.long_weight + g.short_weight == pytest.approx(g.traded_weight)
        assert g.long_weight == pytest.approx(g.short_weight)  # every fold ends without positions


def test_leg_statistics_without_legs(spark, book):
    still = book.withColumn("weight", F.when(F.col("fold") == 1, 0.0).otherwise(F.col("weight")))
    got = {r.fold: r for r in tr.leg_statistics(bt.trade_legs(still), still, ("fold",)).collect()}
    assert (got[1].periods, got[1].trade_legs, got[1].p90_weight, got[1].idle_fraction) == (40, 0, 0.0, 1.0) and got[0].trade_legs > 0
    one = spark.createDataFrame([(0, "a", 0, 0.5)], "fold int, symbol string, t long, weight double")
    (r,) = tr.leg_statistics(bt.trade_legs(one), one).collect()
    assert (r.entries, r.forced_fold_closes, r.rebalance_events, r.mean_hours_between, r.idle_fraction) == (1, 1, 1, 0.0, 0.0)
    (r,) = tr.leg_statistics(bt.trade_legs(one.limit(0)), one.limit(0)).collect()
    assert (r.periods, r.trade_legs, r.idle_fraction) == (0, 0, 0.0)


def test_pairs_that_never_traded(spark, book):
    p = bt.positions(book)
    pairs = book.select("fold", "t", "symbol", F.lit("p").alias("other"), F.col("weight").alias("pair_weight"))
    models = spark.createDataFrame([(f, o, 1.5, 4.0, o == "p") for f in (0, 1, 2) for o in "pq"], "fold int, other string, beta double, half_life double, eligible boolean")
    got = {(r.fold, r.other): r for r in bt.pair_diagnostics(p, pairs, models).collect()}
    assert len(got) == 6 and all((got[f, "q"].net_pnl, got[f, "q"].turnover, got[f, "q"].eligible) == (0.0, 0.0, False) for f in (0, 1, 2))
    total = p.agg(F.sum("net_contribution")).first()[0]
    assert sum(got[f, "p"].net_pnl for f in (0, 1, 2)) == pytest.approx(total)
