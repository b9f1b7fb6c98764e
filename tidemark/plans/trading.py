"""Registered queries of closed trades, legs of rebalancing and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import HOUR_MS
from ..operators import backtest as bt
from ..operators import features as fx
from ..operators import strategies as st
from ..operators import trades as tr
from ..sources.files import staged
from .queries import _PANEL, _W, _weights, query
from .research import _F, _FEAT, _FINITE, _LB, _PAIR, _POS, _USED, _held_sql, _labelled, _positions, _split, _two, _TWO

_FIGURES = {
    "holding_hours_mean": 5, "holding_hours_median": 5, "holding_hours_p10": 5, "holding_hours_p90": 5, "win_rate": 6, "payoff_mean": 6, "payoff_median": 6, "profit_factor": 4, "price_pnl": 5,
    "funding_pnl": 6, "gross_pnl": 5, "explicit_cost": 6, "net_pnl": 5, "turnover": 5, "gross_edge_bps_per_turnover": 3, "net_edge_bps_per_turnover": 3, "explicit_cost_bps_per_turnover": 4,
}


def _places(df: DataFrame, keys: list[str], places: dict[str, int]) -> DataFrame:
    return df.select(*keys, *[(F.round(c, n) + 0.0).alias(c) for c, n in places.items()])


@query(f"""WITH RECURSIVE {_POS},
  a0 AS (
    SELECT *, CASE WHEN abs(weight) > 1e-9 THEN sign(weight) ELSE 0 END AS side, CASE WHEN abs(pw) > 1e-9 THEN sign(pw) ELSE 0 END AS bef FROM po),
  a1 AS (
    SELECT *, lead(t) OVER q AS nt, lead(side) OVER q AS ns, CASE WHEN side <> bef AND side <> 0 THEN 1 ELSE 0 END AS nw
    FROM a0 WINDOW q AS (PARTITION BY fold, symbol ORDER BY t)),
  a2 AS (SELECT *, sum(nw) OVER (PARTITION BY fold, symbol ORDER BY t) AS trade_no FROM a1),
  a3 AS (
    SELECT *, CASE WHEN nw = 1 THEN abs(weight) ELSE abs(weight - pw) END + CASE WHEN nt IS NULL OR ns <> side THEN abs(weight) ELSE 0 END AS moved
    FROM a2 WHERE side <> 0),
  tv AS (
    SELECT symbol, max(side) AS side, min(t) AS entry, (last(coalesce(nt, t) ORDER BY t) - min(t)) / 3600000.0 AS hours, sum(price) AS price_return, sum(funding) AS funding_return,
      sum(moved) AS turnover, sum(moved) * 0.00065 AS cost, CAST(last(nt IS NOT NULL AND ns <> 0 ORDER BY t) AS INTEGER) AS flip
    FROM a3 GROUP BY fold, symbol, trade_no),
  te AS (SELECT *, price_return + funding_return - cost AS net, make_timestamp(CAST(entry * 1000 AS BIGINT)) AS ts FROM tv),
  tg AS (
    SELECT 'overall' AS scope, 'all' AS "group", *, flip AS flips FROM te UNION ALL SELECT 'symbol', symbol, *, 0 FROM te
    UNION ALL SELECT 'side', CASE WHEN side > 0 THEN 'LONG' ELSE 'SHORT' END, *, 0 FROM te UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), *, 0 FROM te
    UNION ALL SELECT 'hour_utc', CAST(hour(ts) AS VARCHAR), *, 0 FROM te UNION ALL SELECT 'entry_reason', 'momentum:signal', *, 0 FROM te),
  tm AS (
    SELECT scope, "group", count(*) AS completed_trades, count(*) AS entries, count(*) AS exits, CAST(sum(flips) AS BIGINT) AS direction_flips, avg(hours) AS holding_hours_mean, median(hours) AS holding_hours_median,
      quantile_cont(hours, 0.1) AS holding_hours_p10, quantile_cont(hours, 0.9) AS holding_hours_p90, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(net) AS payoff_mean,
      median(net) AS payoff_median, sum(greatest(net, 0)) / greatest(sum(greatest(-net, 0)), 1e-15) AS profit_factor, sum(price_return) AS price_pnl, sum(funding_return) AS funding_pnl,
      sum(price_return + funding_return) AS gross_pnl, sum(cost) AS explicit_cost, sum(net) AS net_pnl, sum(turnover) AS turnover, 10000 * sum(price_return + funding_return) / sum(turnover) AS gross_edge_bps_per_turnover,
      10000 * sum(net) / sum(turnover) AS net_edge_bps_per_turnover, 10000 * sum(cost) / sum(turnover) AS explicit_cost_bps_per_turnover
    FROM tg GROUP BY 1, 2)
  SELECT scope, "group", completed_trades, entries, exits, direction_flips, {", ".join(f"round({c}, {n}) + 0.0 AS {c}" for c, n in _FIGURES.items())} FROM tm""")
def trade_metrics_by_grain(s, d):
    """Closed trades of the momentum book, all together and by the five grains."""
    m = tr.trade_metrics(bt.trade_events(_positions(s, d), 1e-9), tr.trade_grains(F.lit("momentum:signal")))
    return _places(m, ["scope", "group", "completed_trades", "entries", "exits", "direction_flips"], _FIGURES)


_LEG_FIGURES = {"traded_weight": 5, "mean_weight": 6, "median_weight": 6, "p90_weight": 6, "maximum_weight": 6, "mean_hours_between": 5, "idle_fraction": 6, "long_weight": 5, "short_weight": 5}


@query(f"""WITH {_PANEL}{_W},
  a AS (SELECT *, lag(weight, 1, 0) OVER q AS p, lead(t) OVER q IS NULL AS lst FROM fw WINDOW q AS (PARTITION BY fold, symbol ORDER BY t)),
  l AS (
    SELECT fold, t, CASE WHEN abs(p) <= 1e-12 THEN 'entry' WHEN abs(weight) <= 1e-12 THEN 'exit' WHEN p * weight < 0 THEN 'flip' WHEN abs(weight) > abs(p) THEN 'increase' ELSE 'reduce' END AS kind,
      abs(weight - p) AS size, weight > p AS bought FROM a WHERE abs(weight - p) > 1e-12
    UNION ALL SELECT fold, t, 'fold_close', abs(weight), weight < 0 FROM a WHERE lst AND abs(weight) > 1e-12),
  pe AS (SELECT fold, count(DISTINCT t) AS periods FROM fw GROUP BY fold),
  g AS (
    SELECT fold, count(DISTINCT t) AS rebalance_events, count(*) AS trade_legs, {", ".join(f"count_if(kind = '{k}') AS {n}" for k, n in tr.LEG_COUNTS.items())}, sum(size) AS traded_weight, avg(size) AS mean_weight,
      median(size) AS median_weight, quantile_cont(size, 0.9) AS p90_weight, max(size) AS maximum_weight, (max(t) - min(t)) / 3600000.0 / (count(DISTINCT t) - 1) AS mean_hours_between,
      coalesce(sum(size) FILTER (bought), 0) AS long_weight, coalesce(sum(size) FILTER (NOT bought), 0) AS short_weight FROM l GROUP BY fold)
  SELECT fold, periods, rebalance_events, trade_legs, {", ".join(tr.LEG_COUNTS.values())},
    {", ".join(f"round({'greatest(0, 1 - rebalance_events / periods)' if c == 'idle_fraction' else c}, {k}) + 0.0 AS {c}" for c, k in _LEG_FIGURES.items())} FROM g JOIN pe USING (fold)""")
def trade_leg_statistics(s, d):
    w = staged(_weights(s, d))
    m = tr.leg_statistics(bt.trade_legs(w), w.select("fold", "t"), ("fold",))
    return _places(m, ["fold", "periods", "rebalance_events", "trade_legs", *tr.LEG_COUNTS.values()], _LEG_FIGURES)


_OTHERS = ["view", "error", "purchase", "signup"]
_BETAS, _HALF_LIVES = (0.0, 3.0), (0.2, 168.0)
_SIZE = 0.2
_PAIRS_SQL = _PAIR.replace("('view', 'error')", "('view', 'error', 'purchase', 'signup')")


@query(f"""WITH RECURSIVE {_FEAT}, pn AS (SELECT * FROM ft JOIN lb USING (symbol, t) WHERE {_FINITE} AND (t // 3600000) % 97 <> 0){_F}{_PAIRS_SQL},
  ml AS (
    SELECT *, CASE WHEN phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END AS half_life,
      coalesce(n = 120 AND beta BETWEEN {_BETAS[0]} AND {_BETAS[1]} AND CASE WHEN phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END BETWEEN {_HALF_LIVES[0]} AND {_HALF_LIVES[1]}, false) AS eligible FROM md),
  te AS (SELECT fold, symbol, t, log_close_level AS y, future_return_1h AS ret, outcome_funding_rate_1h AS rate FROM pn JOIN fd ON t BETWEEN a AND z),
  sp AS (
    SELECT o.fold, o.t, o.symbol, (o.y - alpha - beta * b.y - mean) / std AS zz
    FROM te o JOIN te b ON b.fold = o.fold AND b.t = o.t AND b.symbol = 'click' AND o.symbol <> 'click' JOIN ml ON ml.fold = o.fold AND ml.other = o.symbol AND eligible),
  se AS (SELECT *, CASE WHEN abs(zz) >= 1.5 THEN -sign(zz) ELSE 0 END AS entry FROM sp){_held_sql('se', 24, 'abs(zz) <= 0.5')},
  lg AS (
    SELECT fold, t, symbol AS other, symbol, {_SIZE} * pos AS w FROM hs
    UNION ALL SELECT hs.fold, hs.t, other, 'click', -{_SIZE} * beta * pos FROM hs JOIN ml ON ml.fold = hs.fold AND ml.other = hs.symbol),
  bk AS (SELECT te.*, coalesce(w, 0) AS weight FROM te LEFT JOIN (SELECT fold, t, symbol, sum(w) AS w FROM lg GROUP BY ALL) USING (fold, t, symbol)),
  bt AS (SELECT *, abs(weight - lag(weight, 1, 0) OVER q) + CASE WHEN lead(t) OVER q IS NULL THEN abs(weight) ELSE 0 END AS trade FROM bk WINDOW q AS (PARTITION BY fold, symbol ORDER BY t)),
  pd AS (
    SELECT lg.*, bt.ret, bt.rate, CASE WHEN trade > 1e-15 THEN 0.00065 ELSE 0 END AS cost,
      abs(w - lag(w, 1, 0) OVER q) + CASE WHEN lead(lg.t) OVER q IS NULL THEN abs(w) ELSE 0 END AS moved
    FROM lg JOIN bt USING (fold, t, symbol) WINDOW q AS (PARTITION BY fold, other, symbol ORDER BY t)),
  pg AS (SELECT fold, other, sum(w * ret) AS price_pnl, sum(-w * rate) AS funding_pnl, sum(moved * cost) AS explicit_cost, sum(moved) AS turnover FROM pd GROUP BY 1, 2)
  SELECT fold, other, eligible, round(beta, 5) + 0.0 AS beta, round(half_life, 4) AS half_life, round(coalesce(price_pnl, 0), 5) + 0.0 AS price_pnl, round(coalesce(funding_pnl, 0), 7) + 0.0 AS funding_pnl,
    round(coalesce(explicit_cost, 0), 6) AS explicit_cost, round(coalesce(turnover, 0), 4) AS turnover, round(coalesce(price_pnl + funding_pnl - explicit_cost, 0), 5) + 0.0 AS net_pnl FROM ml LEFT JOIN pg USING (fold, other)""")
def pair_diagnostics(s, d):
    """All pairs with the base through limits on beta and half-life that refuse some of them, held by their spread's z,
    and what each pair earned and paid in one book."""
    x = fx.known_rows(_labelled(s, d, [*_USED, "log_close_level"]), [*_USED, *_LB]).where((F.floor(F.col("t") / HOUR_MS) % 97 != 0) & F.col("label_end_time_ms").isNotNull())
    train, test = _split(x)
    models = staged(st.pair_models(train, "click", _OTHERS, 120, 48, _BETAS, _HALF_LIVES))
    test = staged(test.select("fold", "symbol", "t", "log_close_level", F.col("future_return_1h").alias("ret"), F.col("outcome_funding_rate_1h").alias("funding_rate")))
    legs = st.pair_legs(st.pair_spread_reversion(models, test, "click", 1.5, 24), "click")
    legs = staged(legs.select("fold", "t", "other", "symbol", (_SIZE * F.col("raw")).alias("pair_weight")))
    book = test.join(legs.groupBy("fold", "t", "symbol").agg(F.sum("pair_weight").alias("weight")), ["fold", "t", "symbol"], "left").na.fill(0.0, ["weight"])
    m = bt.pair_diagnostics(bt.positions(book), legs, models)
    m = m.withColumn("half_life", F.when(F.col("half_life") < float("inf"), F.col("half_life")))
    return _places(m, ["fold", "other", "eligible"], {"beta": 5, "half_life": 4, "price_pnl": 5, "funding_pnl": 7, "explicit_cost": 6, "turnover": 4, "net_pnl": 5})


_SHARES = {"momentum": 0.4, "carry": 0.6}


@query(f"""WITH RECURSIVE {_TWO},
  w AS (SELECT 'momentum' AS component, {_SHARES["momentum"]} AS share, * FROM ska UNION ALL BY NAME SELECT 'carry' AS component, {_SHARES["carry"]} AS share, * FROM skb),
  x AS (SELECT *, abs(weight - lag(weight, 1, 0) OVER q) + CASE WHEN lead(t) OVER q IS NULL THEN abs(weight) ELSE 0 END AS trade FROM w WINDOW q AS (PARTITION BY component, fold, symbol ORDER BY t)),
  g AS (
    SELECT component, symbol, sum(share * weight * ret) AS price_pnl, sum(-share * weight * funding_rate) AS funding_pnl, sum(share * trade) AS trade_weight,
      sum(share * (weight * ret - weight * funding_rate - 0.00065 * trade)) AS net_contribution FROM x GROUP BY 1, 2)
  SELECT component, symbol, round(price_pnl, 5) + 0.0 AS price_pnl, round(funding_pnl, 7) + 0.0 AS funding_pnl, round(trade_weight, 4) AS trade_weight, round(net_contribution, 5) + 0.0 AS net_contribution,
    round(abs(net_contribution) / sum(abs(net_contribution)) OVER (), 5) AS share FROM g""")
def component_attribution(s, d):
    """What two components of a portfolio earned and paid by symbol, by their shares of the capital."""
    parts = zip(_SHARES.items(), _two(s, d), strict=True)
    rows = [w.select(F.struct(F.lit(n).alias("component"), "fold").alias("fold"), F.lit(x).alias("capital"), "symbol", "t", "weight", "ret", "funding_rate") for (n, x), w in parts]
    p = bt.positions(rows[0].unionByName(rows[1])).withColumn("component", F.col("fold.component"))
    a = bt.attribution(p, ["component", "symbol"], F.col("capital"))
    return _places(a, ["component", "symbol"], {"price_pnl": 5, "funding_pnl": 7, "trade_weight": 4, "net_contribution": 5, "share": 5})
