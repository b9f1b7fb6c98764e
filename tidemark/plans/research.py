"""Registered queries of features, labels, strategies, policies, accounting, validation and the registry.

Bars of 7.5 minutes made of events (the event type is the symbol) play the minute bars, eight to an hour; an hour
without events has its last close and no volume. Rates of funding are made of eight hours' mean values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import HOUR_MS, epoch_ms
from ..operators import backtest as bt
from ..operators import bars as br
from ..operators import features as fx
from ..operators import joins as jn
from ..operators import portfolio as pf
from ..operators import registry as rg
from ..operators import strategies as st
from ..operators import validation as va
from ..operators import windows as wn
from ..sources.files import staged
from .queries import _MS, END, START, _events, _round, query

STEP, HOUR, LEADERS, BETA = 450_000, 8, ("click", "view"), 72
SETTINGS = {"leaders": LEADERS, "beta_hours": BETA}
ALL = [o for b in fx.BUNDLES for o in b.outputs]


def _bars15(s, d) -> DataFrame:
    b = br.bars(_events(s, d), STEP)
    grid = b.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(START), F.lit(END - STEP), F.lit(STEP))).alias("t"))
    rows = grid.join(b, ["symbol", "t"], "left").withColumn("close", F.last("close", ignorenulls=True).over(wn.by_symbol())).where("close IS NOT NULL")
    volume = F.coalesce("volume", F.lit(0.0))
    taker = volume * (F.coalesce("trades", F.lit(0)) * 3 % 7) / 6.0
    return rows.select("symbol", "t", *[F.coalesce(c, "close").alias(c) for c in ("open", "high", "low")], "close", volume.alias("quote_volume"), taker.alias("taker_quote_volume"))


def _rates(s, d) -> DataFrame:
    e = _events(s, d).select(F.col("event_type").alias("symbol"), epoch_ms(F.col("ts")).alias("ms"), "value")
    t = (F.floor(F.col("ms") / (8 * HOUR_MS)) + 1) * 8 * HOUR_MS
    return e.groupBy("symbol", t.alias("funding_t")).agg(((F.avg("value") - 50) / 1e5).alias("funding_rate"))


def _features(s, d, names=ALL) -> DataFrame:
    return fx.Registry().compute(fx.decision_rows(staged(_bars15(s, d)), HOUR, STEP), list(names), SETTINGS, {"rates": _rates(s, d)})


def _labelled(s, d, names=ALL) -> DataFrame:
    return staged(fx.labels(_features(s, d, names), LEADERS, _rates(s, d), HOUR * STEP))


def _n(c: str, n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)".replace("symbol", c)


def _sum(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_n('symbol', n)} = {n} THEN sum({x}) OVER {_n('symbol', n)} END"


def _zs(x: str, n: int) -> str:
    w = _n("symbol", n)
    return f"CASE WHEN count({x}) OVER {w} < {n} THEN NULL WHEN stddev_pop({x}) OVER {w} <= 1e-15 THEN 0 ELSE ({x} - avg({x}) OVER {w}) / stddev_pop({x}) OVER {w} END"


def _cs(x: str) -> str:
    return f"CASE WHEN stddev_pop({x}) OVER (PARTITION BY t) <= 1e-15 THEN 0 ELSE ({x} - avg({x}) OVER (PARTITION BY t)) / stddev_pop({x}) OVER (PARTITION BY t) END"


_S = "(PARTITION BY symbol ORDER BY t)"
_FEAT = f"""ev AS (SELECT *, {_MS} AS ms FROM events),
  b15 AS (SELECT event_type AS symbol, CAST(ms // {STEP} * {STEP} AS BIGINT) AS t, first(value ORDER BY ts, event_id) AS o, max(value) AS h, min(value) AS l, last(value ORDER BY ts, event_id) AS c, sum(value) AS v, count(*) AS n FROM ev GROUP BY 1, 2),
  gr AS (SELECT symbol, unnest(generate_series({START}, {END - STEP}, {STEP})) AS t FROM (SELECT DISTINCT symbol FROM b15)),
  fl AS (SELECT symbol, t, o, h, l, last_value(c IGNORE NULLS) OVER {_S} AS close, coalesce(v, 0) AS quote_volume, coalesce(n, 0) AS n FROM gr LEFT JOIN b15 USING (symbol, t)),
  mb AS (SELECT symbol, t, coalesce(o, close) AS open, coalesce(h, close) AS high, coalesce(l, close) AS low, close, quote_volume, quote_volume * (n * 3 % 7) / 6.0 AS taker, (t // {STEP}) % {HOUR} % {HOUR // 4} = 0 AS q FROM fl WHERE close IS NOT NULL),
  mr AS (SELECT *, ln(close) AS lc, ln(close) - lag(ln(close)) OVER s AS r1, ln(close) - lag(ln(close), 5) OVER s AS r5, ln(close) - lag(ln(close), 15) OVER s AS r15, lead(t) OVER s AS xt, lead(open) OVER s AS xo, lead(t, {HOUR + 1}) OVER s AS lt, lead(open, {HOUR + 1}) OVER s AS lo,
    CASE WHEN count(quote_volume) OVER a = {HOUR} THEN sum(quote_volume) OVER a END AS av, 2 * taker - quote_volume AS signed FROM mb WINDOW s AS (PARTITION BY symbol ORDER BY t), a AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {HOUR} FOLLOWING)),
  dr AS (SELECT symbol, CAST((t // {HOUR * STEP} + 1) * {HOUR * STEP} - 1 AS BIGINT) AS t, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, last(lc ORDER BY t) AS lc, last(r5 ORDER BY t) AS r5, last(r15 ORDER BY t) AS r15, last(xt ORDER BY t) AS xt, last(xo ORDER BY t) AS xo,
    last(lt ORDER BY t) AS lt, last(lo ORDER BY t) AS lo, last(av ORDER BY t) AS av, sum(r1 * r1) AS r2, sum(signed) AS signed, sum(quote_volume) AS qv, sum(taker) AS taker, sum(signed) FILTER (q) AS qs, sum(quote_volume) FILTER (q) AS qq, sum(signed) FILTER (NOT q) AS os, sum(quote_volume) FILTER (NOT q) AS oq,
    sum(ln(close) - ln(open)) FILTER (q) AS qr FROM mr GROUP BY symbol, t // {HOUR * STEP}, 2 HAVING count(*) = {HOUR}),
  m1 AS (SELECT *, lc - lag(lc) OVER {_S} AS log_return_1h, lc - lag(lc, 4) OVER {_S} AS log_return_4h, lc - lag(lc, 24) OVER {_S} AS log_return_24h FROM dr),
  m2 AS (SELECT *, max(CASE WHEN symbol = 'click' THEN log_return_1h END) OVER (PARTITION BY t) AS c, max(CASE WHEN symbol = 'view' THEN log_return_1h END) OVER (PARTITION BY t) AS v, lo / xo - 1 AS future_return_1h FROM m1),
  m3 AS (SELECT *, CASE symbol WHEN 'click' THEN v WHEN 'view' THEN c ELSE (c + v) / 2 END AS benchmark_return_1h, max(CASE WHEN symbol = 'click' THEN future_return_1h END) OVER (PARTITION BY t) AS fc, max(CASE WHEN symbol = 'view' THEN future_return_1h END) OVER (PARTITION BY t) AS fv FROM m2),
  m4 AS (SELECT *, CASE WHEN count(log_return_1h * benchmark_return_1h) OVER w = {BETA} AND var_pop(benchmark_return_1h) OVER w > 1e-18 THEN covar_pop(log_return_1h, benchmark_return_1h) OVER w / var_pop(benchmark_return_1h) OVER w END AS rolling_beta FROM m3 WINDOW w AS {_n('symbol', BETA)}),
  m5 AS (SELECT *, log_return_1h - rolling_beta * benchmark_return_1h AS residual_momentum_1h, row_number() OVER {_S} AS k FROM m4),
  mk AS (SELECT t, CASE WHEN count(log_return_1h) = 2 THEN avg(log_return_1h) END AS m FROM m1 WHERE symbol IN ('click', 'view') GROUP BY t),
  mk2 AS (SELECT t, CASE WHEN count(m) OVER w = 24 THEN stddev_pop(m) OVER w * sqrt(8760) END AS market_volatility_regime FROM mk WINDOW w AS (ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
  f1 AS (SELECT *, {_sum('residual_momentum_1h', 4)} AS residual_momentum_4h, {_sum('residual_momentum_1h', 24)} AS residual_momentum_24h, CASE WHEN k >= 24 THEN sqrt(sum(r2) OVER {_n('symbol', 24)}) END AS realized_volatility_24h,
    CASE WHEN k >= 4 THEN max(high) OVER {_n('symbol', 4)} / min(low) OVER {_n('symbol', 4)} - 1 END AS intraday_range_4h, {_zs('qv', 24)} AS quote_volume_zscore_24h, CASE WHEN qv > 0 THEN 2 * taker / qv - 1 END AS taker_buy_imbalance_1h,
    CASE WHEN qq > 0 THEN qs / qq END AS quarter_open_flow_share_1h, CASE WHEN oq > 0 THEN os / oq END AS non_open_flow_share_1h, CASE WHEN qv > 0 THEN signed / qv END AS signed_taker_flow_share_1h,
    {_sum('log_return_1h * log_return_1h', 4)} AS v4, {_sum('log_return_1h * log_return_1h', 168)} AS v168, CASE WHEN k > 72 THEN max(high) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING) END AS prior_high_72h,
    CASE WHEN k > 72 THEN min(low) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING) END AS prior_low_72h, abs(lc - lag(lc) OVER {_S}) AS dd, abs(lc - lag(lc, 24) OVER {_S}) AS net FROM m5),
  f2 AS (SELECT *, quarter_open_flow_share_1h - non_open_flow_share_1h AS quarter_flow_excess_1h, {_zs('signed_taker_flow_share_1h', 168)} AS signed_taker_flow_z_168h, realized_volatility_24h / sqrt(24) AS hourly_volatility_proxy, log_return_1h / greatest(realized_volatility_24h / sqrt(24), CASE WHEN realized_volatility_24h IS NOT NULL THEN 1e-15 END) AS vol_scaled_return_1h,
    sqrt(v4) AS realized_volatility_4h, sqrt(v168) AS realized_volatility_168h, sqrt(v4) / CASE WHEN v168 IS NOT NULL THEN greatest(sqrt(v168) * sqrt(4.0 / 168.0), 1e-15) END AS volatility_compression_4h_168h,
    CASE WHEN prior_high_72h - prior_low_72h > 1e-15 THEN (close - prior_low_72h) / (prior_high_72h - prior_low_72h) END AS range_position_72h,
    CASE WHEN count(dd) OVER {_n('symbol', 24)} < 24 THEN NULL WHEN sum(dd) OVER {_n('symbol', 24)} <= 1e-15 THEN 0 ELSE net / sum(dd) OVER {_n('symbol', 24)} END AS efficiency_ratio_24h FROM f1),
  fr0 AS (SELECT event_type AS symbol, CAST((ms // 28800000 + 1) * 28800000 AS BIGINT) AS funding_t, (avg(value) - 50) / 1e5 AS rate FROM ev GROUP BY 1, 2), fr AS (SELECT *, rate - lag(rate) OVER (PARTITION BY symbol ORDER BY funding_t) AS change FROM fr0),
  ft AS (SELECT f2.symbol, f2.t, high, low, close, lc AS log_close_level, r5 AS log_return_5m, r15 AS log_return_15m, log_return_1h, log_return_4h, log_return_24h, benchmark_return_1h, rolling_beta, residual_momentum_1h, residual_momentum_4h, residual_momentum_24h, realized_volatility_24h, intraday_range_4h, market_volatility_regime,
    qv AS quote_volume_1h, quote_volume_zscore_24h, taker_buy_imbalance_1h, fr.rate AS funding_rate_current, fr.change AS funding_rate_change, qs AS quarter_open_signed_flow_1h, qq AS quarter_open_quote_volume_1h, quarter_open_flow_share_1h, non_open_flow_share_1h, quarter_flow_excess_1h, qr AS quarter_open_return_1h,
    {_zs('quarter_open_flow_share_1h', 168).replace('symbol', 'f2.symbol').replace('ORDER BY t', 'ORDER BY f2.t')} AS quarter_open_flow_z_168h, {_zs('quarter_flow_excess_1h', 168).replace('symbol', 'f2.symbol').replace('ORDER BY t', 'ORDER BY f2.t')} AS quarter_flow_excess_z_168h, signed_taker_flow_share_1h, signed_taker_flow_z_168h, hourly_volatility_proxy, vol_scaled_return_1h, sign(signed_taker_flow_z_168h) * vol_scaled_return_1h AS flow_price_agreement_1h,
    realized_volatility_4h, realized_volatility_168h, volatility_compression_4h_168h, prior_high_72h, prior_low_72h, range_position_72h, efficiency_ratio_24h, future_return_1h, future_return_1h - rolling_beta * CASE f2.symbol WHEN 'click' THEN fv WHEN 'view' THEN fc ELSE (fc + fv) / 2 END AS future_residual_return_1h, av AS outcome_quote_volume_1h, xt AS execution_time_ms, lt AS label_end_time_ms
    FROM f2 LEFT JOIN mk2 ON mk2.t = f2.t ASOF LEFT JOIN fr ON fr.symbol = f2.symbol AND f2.t >= fr.funding_t),
  lb AS (SELECT ft.symbol, ft.t, coalesce(sum(rate), 0) AS outcome_funding_rate_1h FROM ft LEFT JOIN fr ON fr.symbol = ft.symbol AND funding_t > execution_time_ms AND funding_t <= label_end_time_ms GROUP BY 1, 2)"""


def _digits(df: DataFrame, columns, places: int = 5) -> DataFrame:
    return df.select("symbol", "t", *[(F.round(c, places) + 0.0).alias(c) for c in columns])


def _digits_sql(columns, places: int = 5) -> str:
    return ", ".join(["symbol", "t", *[f"round({c}, {places}) + 0.0 AS {c}" for c in columns]])


def _register_bundle(bundle: fx.Bundle) -> None:
    def run(s, d):
        return _digits(_features(s, d, bundle.outputs), bundle.outputs)

    query(f"WITH {_FEAT} SELECT {_digits_sql(bundle.outputs)} FROM ft", f"features_{bundle.name}")(run)


for _b in fx.BUNDLES:
    _register_bundle(_b)


_LB = ("future_return_1h", "future_residual_return_1h", "outcome_quote_volume_1h")


@query(f"WITH {_FEAT} SELECT {_digits_sql(_LB)}, round(outcome_funding_rate_1h, 8) + 0.0 AS outcome_funding_rate_1h, execution_time_ms, label_end_time_ms FROM ft JOIN lb USING (symbol, t)")
def labels(s, d):
    x = _labelled(s, d)
    keys = x.select("symbol", "t", (F.round("outcome_funding_rate_1h", 8) + 0.0).alias("outcome_funding_rate_1h"), "execution_time_ms", "label_end_time_ms")
    return _digits(x, _LB).join(keys, ["symbol", "t"])


_USED = ["residual_momentum_1h", "residual_momentum_4h", "residual_momentum_24h", "rolling_beta", "realized_volatility_24h", "market_volatility_regime", "funding_rate_current", "funding_rate_change", "log_return_1h"]
_FINITE = " AND ".join(f"{c} IS NOT NULL" for c in [*_USED, *_LB, "label_end_time_ms"])


#: Faults planted by the number of a row's hour: features of the future, no delay, no horizon, no value, rows twice, rows lost.
_FAULTS = {"late": "h % 50 = 1", "eager": "h % 60 = 2", "short": "h % 70 = 3", "empty": "h % 80 = 4", "twice": "h % 90 = 5", "lost": "h % 100 = 6 AND symbol = 'view'"}


@query(f"""WITH {_FEAT}, r AS (SELECT * FROM ft WHERE {_FINITE}),
  c AS (SELECT symbol, t, t // {HOUR_MS} AS h, execution_time_ms, label_end_time_ms FROM r WHERE t IN (SELECT t FROM r GROUP BY t HAVING count(*) = 5)),
  x AS (
    SELECT symbol, t, t + CASE WHEN {_FAULTS["late"]} THEN 1 ELSE 0 END AS source, CASE WHEN {_FAULTS["eager"]} THEN t ELSE execution_time_ms END AS execution,
      CASE WHEN {_FAULTS["short"]} THEN t ELSE label_end_time_ms END AS label, CASE WHEN {_FAULTS["empty"]} THEN 1 ELSE 0 END AS nulls, unnest(CASE WHEN {_FAULTS["twice"]} THEN [1, 2] ELSE [1] END) AS k
    FROM c WHERE NOT ({_FAULTS["lost"]})),
  d AS (SELECT t, symbol, count(*) AS n FROM x GROUP BY ALL), e AS (SELECT t, count(*) AS symbols FROM d GROUP BY t)
  SELECT count(*) AS n_rows, count(DISTINCT t) AS n_decisions, (SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) FROM d) AS duplicate_keys, count_if(source > t) AS feature_after_cutoff, count_if(execution <= t) AS execution_not_after_decision,
    count_if(label <= execution) AS label_not_after_execution, CAST(sum(nulls) AS BIGINT) AS null_features, (SELECT min(symbols) = max(symbols) FROM e) AS complete, min(t) AS first_ms, max(t) AS last_ms FROM x""")
def point_in_time_audit(s, d):
    rows = fx.dataset(_labelled(s, d), _USED, 5, 168 * HOUR_MS, fx.known_rows).withColumn("h", F.floor(F.col("decision_time_ms") / HOUR_MS)).where(~F.expr(_FAULTS["lost"]))
    at = F.col("decision_time_ms")
    rows = rows.withColumns({
        "feature_source_max_ms": F.when(F.expr(_FAULTS["late"]), at + 1).otherwise(F.col("feature_source_max_ms")), "execution_time_ms": F.when(F.expr(_FAULTS["eager"]), at).otherwise(F.col("execution_time_ms")),
        "label_end_time_ms": F.when(F.expr(_FAULTS["short"]), at).otherwise(F.col("label_end_time_ms")), _USED[0]: F.when(~F.expr(_FAULTS["empty"]), F.col(_USED[0])),
    })
    rows = rows.withColumn("k", F.explode(F.when(F.expr(_FAULTS["twice"]), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return fx.point_in_time_audit(rows, _USED)


@query(f"WITH {_FEAT} SELECT symbol, t, round(close, 6) AS close FROM ft WHERE (t + 1) % 14400000 = 0")
def sampled_decisions(s, d):
    return _round(fx.sample_decisions(fx.decision_rows(_bars15(s, d), HOUR, STEP), 4 * HOUR_MS).select("symbol", "t", "close"), "close")


#: The panel of strategies: rows with the features they use, an hour left out now and then so that time has breaks.
_PN = _FEAT + f", pn AS (SELECT * FROM ft WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _USED)} AND (t // 3600000) % 97 <> 0)"


def _pn(s, d, names=ALL) -> DataFrame:
    return staged(fx.known_rows(_features(s, d, names), _USED).where(F.floor(F.col("t") / HOUR_MS) % 97 != 0))


_SEG = f", g0 AS (SELECT *, CASE WHEN t - lag(t) OVER {_S} > 3600000 THEN 1 ELSE 0 END AS gap FROM pn), sg AS (SELECT *, sum(gap) OVER {_S} AS seg FROM g0)"
_IN = "(PARTITION BY symbol, seg ORDER BY t ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _trail(n: int) -> str:
    w = _IN.format(n - 1)
    return f"CASE WHEN count(log_return_1h) OVER {w} = {n} THEN sum(log_return_1h) OVER {w} END"


def _carried(name: str, expr: str, source: str) -> str:
    return f", {name}0 AS (SELECT *, {expr} AS {name}_raw FROM {source}), {name}t AS (SELECT *, last_value({name}_raw IGNORE NULLS) OVER {_S} AS {name} FROM {name}0)"


_SMA = _SEG + ", pp AS (SELECT *, exp(sum(log_return_1h) OVER w - first_value(log_return_1h) OVER w) AS p, row_number() OVER w AS kk FROM sg WINDOW w AS (PARTITION BY symbol, seg ORDER BY t))" + _carried("sma", f"CASE WHEN kk >= 24 THEN ln(avg(p) OVER {_IN.format(5)} / avg(p) OVER {_IN.format(23)}) END", "pp")
_RS = lambda n: _SEG + _carried("rs", _trail(n), "sg")
_CARRY = f"-0.6 * ({_cs('funding_rate_current')}) - 0.2 * ({_cs('funding_rate_change')}) + 0.2 * ({_cs('residual_momentum_4h')})"
_MULTI = _SEG + _carried("fa", _trail(12), "sg") + _carried("sl", _trail(36), "fat") + f", mh AS (SELECT *, {_CARRY} AS carry_score, {_cs('fa')} AS fast_strength_score, {_cs('sl')} AS slow_strength_score FROM slt)"
_REGIME = _carried("rf", _trail(6), "sg").replace("FROM sg)", "FROM {})") + _carried("rw", _trail(24), "rft")
_ST: dict = {
    "residual_momentum": (lambda p: st.residual_momentum(p), "", f"0.2 * ({_cs('residual_momentum_1h')}) + 0.3 * ({_cs('residual_momentum_4h')}) + 0.5 * ({_cs('residual_momentum_24h')})", "pn"),
    "residual_mean_reversion": (lambda p: st.residual_mean_reversion(p, adjustment=0.5), "", f"-(0.5 * ({_cs('residual_momentum_1h')}) + 0.5 * ({_cs('residual_momentum_4h')})) / pow(greatest(CASE WHEN quantile_cont(realized_volatility_24h, 0.5) OVER (PARTITION BY t) > 1e-15 THEN realized_volatility_24h / quantile_cont(realized_volatility_24h, 0.5) OVER (PARTITION BY t) ELSE 1 END, 1e-12), 0.5)", "pn"),
    "funding_carry": (lambda p: st.funding_carry(p), "", _CARRY, "pn"),
    "sma_crossover": (lambda p: st.sma_crossover(p, 6, 24), _SMA, _cs("sma"), "smat"),
    "sma_trend_strength": (lambda p: st.sma_trend_strength(p, 6, 24), _SMA, "sma", "smat"),
    "relative_strength": (lambda p: st.relative_strength(p, 24), _RS(24), _cs("rs"), "rst"),
    "multi_horizon_trend_full": (lambda p: st.multi_horizon_trend(p, (6, 24, 48), (0.5, 0.3, 0.2)), _SEG + _carried("ta", _trail(6), "sg") + _carried("tb", _trail(24), "tat") + _carried("tc", _trail(48), "tbt"), "CAST(0.5 * sign(ta) + 0.3 * sign(tb) + 0.2 * sign(tc) AS DOUBLE)", "tct"),
    "market_regime_trend": (lambda p: st.market_regime_trend(p, 6, 24), _SEG + _REGIME.format("sg"), "CASE WHEN rf IS NOT NULL AND rw IS NOT NULL THEN CASE WHEN avg(rw) OVER (PARTITION BY t) > 0 AND rf > 0 AND rw > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END END", "rwt"),
    "carry_relative_strength": (lambda p: st.carry_relative_strength(p, 24), _RS(24), f"({_CARRY} + {_cs('rs')}) / 2", "rst"),
    "carry_dual_trend": (lambda p: st.carry_dual_trend(p, 24, 6, 24), _SMA + _carried("rs", _trail(24), "smat"), f"({_CARRY} + {_cs('rs')} + {_cs('sma')}) / 3", "rst"),
    "carry_multi_horizon": (lambda p: st.carry_multi_horizon(p, 12, 36), _MULTI, "(carry_score + fast_strength_score + slow_strength_score) / 3", "mh"),
    "carry_multi_regime": (lambda p: st.carry_multi_regime(p, 12, 36, 6, 24), _MULTI + _REGIME.format("mh"), "(carry_score + fast_strength_score + slow_strength_score) / 3 + 10 * CASE WHEN rf IS NOT NULL AND rw IS NOT NULL THEN CASE WHEN avg(rw) OVER (PARTITION BY t) > 0 AND rf > 0 AND rw > 0 THEN 1.0 ELSE 0.0 END END", "rwt"),
    "carry_consensus_strength": (lambda p: st.carry_consensus_strength(p, 12, 36), _MULTI, "(carry_score + CASE WHEN sign(fast_strength_score) = sign(slow_strength_score) THEN (fast_strength_score + slow_strength_score) / 2 ELSE 0 END) / 2", "mh"),
}


def _register_strategy(name: str, score, cte: str, expr: str, source: str) -> None:
    def run(s, d):
        out = score(_pn(s, d, _USED))
        if name == "carry_multi_regime":  # both scores in one number
            out = out.withColumn("score", F.col("score") + 10 * F.col("regime_trend_score"))
        return _digits(out, ["score"])

    query(f"WITH {_PN}{cte}, z9 AS (SELECT symbol, t, {expr} AS score FROM {source}) SELECT {_digits_sql(['score'])} FROM z9", f"strategy_{name}")(run)


for _name, _x in _ST.items():
    _register_strategy(_name, *_x)


@query(f"""WITH RECURSIVE {_PN}{_SEG}, pp AS (SELECT symbol, t, seg, exp(sum(log_return_1h) OVER w - first_value(log_return_1h) OVER w) AS p, row_number() OVER w AS kk FROM sg WINDOW w AS (PARTITION BY symbol, seg ORDER BY t)),
  ch AS (SELECT *, max(p) OVER (PARTITION BY symbol, seg ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS eh, min(p) OVER (PARTITION BY symbol, seg ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS el,
    max(p) OVER (PARTITION BY symbol, seg ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS xh, min(p) OVER (PARTITION BY symbol, seg ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS xl FROM pp),
  st AS (SELECT symbol, seg, t, kk, 0.0::DOUBLE AS pos FROM ch WHERE kk = 1
    UNION ALL SELECT c.symbol, c.seg, c.t, c.kk, CASE WHEN c.kk <= 24 THEN 0.0 WHEN c.p > c.eh THEN 1.0 WHEN c.p < c.el THEN -1.0 WHEN (st.pos > 0 AND c.p < c.xl) OR (st.pos < 0 AND c.p > c.xh) THEN 0.0 ELSE st.pos END FROM st JOIN ch c ON c.symbol = st.symbol AND c.seg = st.seg AND c.kk = st.kk + 1)
  SELECT symbol, t, pos AS score FROM st""")
def strategy_donchian_breakout(s, d):
    return st.donchian_breakout(_pn(s, d, _USED), 24, 8).select("symbol", "t", "score")


_F = """, tn AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM pn)), fk AS (SELECT t, i, CAST((i - 169) // 48 AS INTEGER) AS fold FROM tn WHERE i >= 169),
  fd AS (SELECT fold, min(t) AS a, max(t) AS z, (SELECT t FROM tn WHERE tn.i = min(fk.i) - 2) AS e FROM fk GROUP BY fold HAVING count(*) = 48)"""


def _split(p: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows by fold."""
    f = bt.folds(p.select("t"), 168, 48, 1)
    keep = lambda x: x.drop("train_start", "train_end", "test_start", "test_end")
    rows = p if rows is None else rows
    return keep(jn.with_folds(rows, f, "t", "train_start", "train_end")), keep(jn.with_folds(rows, f, "t", "test_start", "test_end"))


@query(f"""WITH {_PN}{_SMA}{_F}, tr AS (SELECT DISTINCT fold, t, market_volatility_regime AS m FROM pn JOIN fd ON t <= e), q AS (SELECT fold, quantile_cont(m, 0.8) AS lim FROM tr GROUP BY fold)
  SELECT fold, symbol, t, round(CASE WHEN market_volatility_regime > lim THEN 0 ELSE sma END, 5) + 0.0 AS score FROM smat JOIN fd ON t BETWEEN a AND z JOIN q USING (fold)""")
def strategy_volatility_filtered_sma(s, d):
    p = _pn(s, d, _USED)
    train, test = _split(p, st.sma_ratio(p, 6, 24))
    return st.volatility_filtered_sma(train, test).select("fold", "symbol", "t", (F.round("score", 5) + 0.0).alias("score"))


@query()
def strategy_linear_cross_sectional(s, d):
    x = _labelled(s, d, [*_USED, "quote_volume_zscore_24h", "taker_buy_imbalance_1h"]).where(F.floor(F.col("t") / HOUR_MS) % 97 != 0)
    p = fx.finite_rows(x, [*_USED, "quote_volume_zscore_24h", *_LB]).withColumn("taker_buy_imbalance_1h", F.coalesce("taker_buy_imbalance_1h", F.lit(0.0)))
    return st.linear_cross_sectional(*_split(p)).select("fold", "symbol", "t", "score")


def _held_sql(source: str, hours: int, leave: str = "false") -> str:
    return f""", en AS (SELECT *, row_number() OVER (PARTITION BY fold, symbol ORDER BY t) AS n, {leave} AS lv FROM {source}),
  hs AS (SELECT fold, symbol, t, n, CAST(entry AS DOUBLE) AS pos, CASE WHEN entry <> 0 THEN {hours - 1} ELSE 0 END AS rest FROM en WHERE n = 1
    UNION ALL SELECT e.fold, e.symbol, e.t, e.n, CASE WHEN hs.pos <> 0 THEN CASE WHEN coalesce(e.lv, false) OR hs.rest <= 0 THEN 0.0 ELSE hs.pos END ELSE CAST(e.entry AS DOUBLE) END,
      CASE WHEN hs.pos <> 0 THEN CASE WHEN coalesce(e.lv, false) OR hs.rest <= 0 THEN 0 ELSE hs.rest - 1 END WHEN e.entry <> 0 THEN {hours - 1} ELSE 0 END FROM hs JOIN en e ON e.fold = hs.fold AND e.symbol = hs.symbol AND e.n = hs.n + 1)"""


_QH = f", qh AS (SELECT *, ({_sum('quarter_flow_excess_z_168h', 4)}) / 4 AS m FROM pn), qe AS (SELECT fold, symbol, t, CASE WHEN abs(m) >= 1 THEN greatest(-3, least(3, m)) ELSE 0 END AS entry FROM qh JOIN fd ON t BETWEEN a AND z), q1 AS (SELECT fold, symbol, t, coalesce(entry, 0) AS entry FROM qe)"


@query(f"WITH RECURSIVE {_PN}{_F}{_QH}{_held_sql('q1', 4)} SELECT fold, symbol, t, round(pos, 5) + 0.0 AS score FROM hs")
def strategy_quarter_hour_flow(s, d):
    p = _pn(s, d, [*_USED, "quarter_flow_excess_z_168h"])
    _, test = _split(p, st.quarter_hour_flow(p))
    return st.held(test.select("fold", "symbol", "t", "entry"), 4).select("fold", "symbol", "t", (F.round("score", 5) + 0.0).alias("score"))


_FA = ", fe AS (SELECT fold, symbol, t, CASE WHEN abs(signed_taker_flow_z_168h) >= 1.0 AND quote_volume_zscore_24h >= 0 AND flow_price_agreement_1h <= 0.25 THEN -greatest(-3, least(3, signed_taker_flow_z_168h)) ELSE 0 END AS entry FROM pn JOIN fd ON t BETWEEN a AND z)"


@query(f"WITH RECURSIVE {_PN}{_F}{_FA}{_held_sql('fe', 8)} SELECT fold, symbol, t, round(pos, 5) + 0.0 AS score FROM hs")
def strategy_flow_absorption(s, d):
    p = _pn(s, d)
    _, test = _split(p, st.flow_absorption(p, 1.0))
    return st.held(test.select("fold", "symbol", "t", "entry"), 8).select("fold", "symbol", "t", (F.round("score", 5) + 0.0).alias("score"))


_CB = f""", c0 AS (SELECT *, lag(volatility_compression_4h_168h) OVER {_S} AS pc FROM pn), cq AS (SELECT fold, symbol, quantile_cont(volatility_compression_4h_168h, 0.5) AS lim FROM pn JOIN fd ON t <= e WHERE volatility_compression_4h_168h IS NOT NULL GROUP BY 1, 2),
  ce AS (SELECT fold, symbol, t, CASE WHEN pc <= lim AND quote_volume_zscore_24h >= 0 AND efficiency_ratio_24h >= 0.25 AND close > prior_high_72h THEN 1 WHEN pc <= lim AND quote_volume_zscore_24h >= 0 AND efficiency_ratio_24h >= 0.25 AND close < prior_low_72h THEN -1 ELSE 0 END AS entry FROM c0 JOIN fd ON t BETWEEN a AND z LEFT JOIN cq USING (fold, symbol))"""


@query(f"WITH RECURSIVE {_PN}{_F}{_CB}{_held_sql('ce', 12)} SELECT fold, symbol, t, pos AS score FROM hs")
def strategy_compression_breakout(s, d):
    p = _pn(s, d).withColumn("prior_compression", F.lag("volatility_compression_4h_168h").over(wn.by_symbol()))
    train, test = _split(p)
    return st.held(st.compression_breakout(train, test, 0.5).select("fold", "symbol", "t", "entry"), 12).select("fold", "symbol", "t", "score")


_PAIR = """, px AS (SELECT fold, t, log_close_level AS x FROM pn JOIN fd ON t <= e WHERE symbol = 'click'), py AS (SELECT fold, t, symbol AS other, log_close_level AS y FROM pn JOIN fd ON t <= e WHERE symbol IN ('view', 'error')),
  p0 AS (SELECT *, row_number() OVER (PARTITION BY fold, other ORDER BY t DESC) AS back FROM py JOIN px USING (fold, t)), p1 AS (SELECT * FROM p0 WHERE back <= 120),
  p2 AS (SELECT *, count(*) OVER w AS n, covar_pop(y, x) OVER w / var_pop(x) OVER w AS beta, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM p1 WINDOW w AS (PARTITION BY fold, other)), p3 AS (SELECT *, my - beta * mx AS alpha, y - (my - beta * mx) - beta * x AS er FROM p2),
  p4 AS (SELECT *, er - avg(er) OVER (PARTITION BY fold, other) AS c FROM p3), p5 AS (SELECT *, lead(c) OVER (PARTITION BY fold, other ORDER BY t) AS cn FROM p4),
  md AS (SELECT fold, other, max(n) AS n, max(alpha) AS alpha, max(beta) AS beta, avg(er) FILTER (back <= 48) AS mean, stddev_pop(er) FILTER (back <= 48) AS std, sum(c * cn) / sum(c * c) FILTER (cn IS NOT NULL) AS phi FROM p5 GROUP BY 1, 2)"""


@query(f"WITH {_PN}{_F}{_PAIR} SELECT fold, other, round(alpha, 5) AS alpha, round(beta, 5) AS beta, round(mean, 5) + 0.0 AS mean, round(std, 5) AS std, round(CASE WHEN phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END, 4) AS half_life FROM md")
def strategy_pair_models(s, d):
    train, _ = _split(_pn(s, d, [*_USED, "log_close_level"]))
    m = st.pair_models(train, "click", ["view", "error"], 120, 48)
    h = F.when(F.col("half_life") < float("inf"), F.round("half_life", 4))
    return m.select("fold", "other", *[(F.round(c, 5) + 0.0).alias(c) for c in ("alpha", "beta", "mean", "std")], h.alias("half_life"))


@query(f"""WITH RECURSIVE {_PN}{_F}{_PAIR}, sx AS (SELECT fold, t, log_close_level AS x FROM pn JOIN fd ON t BETWEEN a AND z WHERE symbol = 'click'),
  sp AS (SELECT y.fold, y.t, y.other AS symbol, (y.y - alpha - beta * x - mean) / std AS zz FROM (SELECT fold, t, symbol AS other, log_close_level AS y FROM pn JOIN fd ON t BETWEEN a AND z WHERE symbol IN ('view', 'error')) y JOIN sx USING (fold, t) JOIN md ON md.fold = y.fold AND md.other = y.other),
  se AS (SELECT *, CASE WHEN abs(zz) >= 1.5 THEN -sign(zz) ELSE 0 END AS entry FROM sp){_held_sql('se', 24, 'abs(zz) <= 0.5')} SELECT fold, symbol AS other, t, pos AS side FROM hs""")
def strategy_pair_spread(s, d):
    train, test = _split(_pn(s, d, [*_USED, "log_close_level"]))
    m = staged(st.pair_models(train, "click", ["view", "error"], 120, 48)).withColumn("eligible", F.lit(True))  # random prices pass no gate
    out = st.pair_spread_reversion(m, test, "click", 1.5, 24)
    return out.select("fold", "other", "t", "side")


def _test_rows(s, d) -> DataFrame:
    """Test rows of the momentum score with what policies and accounting read."""
    x = _labelled(s, d, _USED)
    p = fx.known_rows(x, [*_USED, *_LB]).where((F.floor(F.col("t") / HOUR_MS) % 97 != 0) & F.col("label_end_time_ms").isNotNull())
    scored = staged(st.funding_carry(st.residual_momentum(p), name="carry_score"))
    _, test = _split(scored)
    return staged(test.select("fold", "symbol", "t", "score", "carry_score", F.col("rolling_beta").alias("beta"), F.col("realized_volatility_24h").alias("vol"), F.col("future_return_1h").alias("ret"), F.col("outcome_funding_rate_1h").alias("funding_rate"), F.col("outcome_quote_volume_1h").alias("volume"), F.col("market_volatility_regime").alias("regime"), F.col("future_residual_return_1h").alias("outcome")))


_TR = _FEAT + f", pn AS (SELECT * FROM ft JOIN lb USING (symbol, t) WHERE {_FINITE} AND (t // 3600000) % 97 <> 0)" + _F + f", sc AS (SELECT *, 0.2 * ({_cs('residual_momentum_1h')}) + 0.3 * ({_cs('residual_momentum_4h')}) + 0.5 * ({_cs('residual_momentum_24h')}) AS score, {_CARRY} AS carry_score FROM pn), tr AS (SELECT fold, symbol, t, score, carry_score, rolling_beta AS beta, realized_volatility_24h AS vol, future_return_1h AS ret, outcome_funding_rate_1h AS funding_rate, outcome_quote_volume_1h AS volume, market_volatility_regime AS regime, future_residual_return_1h AS outcome FROM sc JOIN fd ON t BETWEEN a AND z)"


def _scaled_sql(name: str, source: str, raw: str) -> str:
    """CTEs that end in ``name`` with weight = raw under the default limits, by fold and time."""
    w = "(PARTITION BY fold, t)"
    return f""", {name}a AS (SELECT *, CASE WHEN sum(abs({raw})) OVER {w} > 1e-15 THEN {raw} / sum(abs({raw})) OVER {w} ELSE 0 END AS u FROM {source}),
  {name}b AS (SELECT *, u * CASE WHEN sum(u * u * vol * vol * 365) OVER {w} > 0 THEN least(0.5, 0.15 / sqrt(sum(u * u * vol * vol * 365) OVER {w})) ELSE 0.5 END AS v FROM {name}a),
  {name} AS (SELECT * EXCLUDE (u, v), v * CASE WHEN max(abs(v)) OVER {w} > 0.25 THEN 0.25 / max(abs(v)) OVER {w} ELSE 1 END AS weight FROM {name}b)"""


def _sticky_sql(name: str, score: str, band: float, every: int, spread: float) -> str:
    """CTEs that end in ``name``: tr's columns and weight of the kept neutral pair."""
    n = name
    return f""", {n}0 AS (SELECT fold, t, row_number() OVER (PARTITION BY fold ORDER BY t) AS n, first(symbol ORDER BY {score} DESC, symbol) AS best, first(symbol ORDER BY {score}, symbol) AS worst, max({score}) AS hi, min({score}) AS lo, map_from_entries(list((symbol, {score}))) AS m FROM tr GROUP BY fold, t),
  {n}1 AS (SELECT fold, n, t, t AS rt, CASE WHEN hi - lo >= {spread} THEN best END AS top, CASE WHEN hi - lo >= {spread} THEN worst END AS bottom FROM {n}0 WHERE n = 1
    UNION ALL SELECT b.fold, b.n, b.t, CASE WHEN b.t - s.rt >= {every} THEN b.t ELSE s.rt END,
      CASE WHEN b.t - s.rt < {every} THEN s.top WHEN b.hi - b.lo < {spread} THEN NULL WHEN s.top IS NOT NULL AND b.hi - b.m[s.top] <= {band} THEN s.top ELSE b.best END,
      CASE WHEN b.t - s.rt < {every} THEN s.bottom WHEN b.hi - b.lo < {spread} THEN NULL WHEN s.bottom IS NOT NULL AND b.m[s.bottom] - b.lo <= {band} THEN s.bottom ELSE b.worst END FROM {n}1 s JOIN {n}0 b ON b.fold = s.fold AND b.n = s.n + 1),
  {n}2 AS (SELECT tr.*, CASE WHEN symbol = top THEN 1.0 ELSE 0.0 END - CASE WHEN symbol = bottom THEN 1.0 ELSE 0.0 END AS raw FROM tr JOIN {n}1 USING (fold, t) WHERE t = rt),
  {n}3 AS (SELECT *, count(*) OVER w AS cn, sum(beta) OVER w AS sb, sum(beta * beta) OVER w AS sbb, sum(raw * beta) OVER w AS srb FROM {n}2 WINDOW w AS (PARTITION BY fold, t)),
  {n}4 AS (SELECT *, raw - CASE WHEN cn * sbb - sb * sb > 1e-12 THEN (cn * beta - sb) * srb / (cn * sbb - sb * sb) ELSE 0 END AS fit FROM {n}3),
  {n}5 AS (SELECT *, CASE WHEN coalesce(min(CASE WHEN raw <> 0 THEN raw * fit END) OVER w > 0, false) AND sum(abs(fit)) OVER w > 1e-12 THEN fit ELSE raw END AS ww FROM {n}4 WINDOW w AS (PARTITION BY fold, t))""" + _scaled_sql(f"{n}w", f"{n}5", "ww") + f""",
  {n} AS (SELECT tr.*, coalesce({n}w.weight, 0) AS weight FROM tr JOIN {n}1 USING (fold, t) LEFT JOIN {n}w ON {n}w.fold = tr.fold AND {n}w.symbol = tr.symbol AND {n}w.t = {n}1.rt)"""


def _weights_out(df: DataFrame) -> DataFrame:
    return df.select("fold", "symbol", "t", (F.round("weight", 5) + 0.0).alias("weight"))


_WOUT = "SELECT fold, symbol, t, round(weight, 5) + 0.0 AS weight FROM"


@query(f"WITH RECURSIVE {_TR}{_sticky_sql('sk', 'score', 0.1, 0, 0)} {_WOUT} sk")
def policy_neutral_long_short(s, d):
    return _weights_out(pf.neutral_long_short(_test_rows(s, d), ["fold"]))


@query(f"WITH RECURSIVE {_TR}{_sticky_sql('sk', 'score', 0.1, 8 * HOUR_MS, 1.5)} {_WOUT} sk")
def policy_buffered_neutral(s, d):
    return _weights_out(pf.neutral_long_short(_test_rows(s, d), ["fold"], 0.1, 8 * HOUR_MS, 1.5))


_PLAN = f""", n0 AS (SELECT fold, t, row_number() OVER (PARTITION BY fold ORDER BY t) AS n FROM (SELECT DISTINCT fold, t FROM tr)),
  n1 AS (SELECT fold, n, t, t AS rt FROM n0 WHERE n = 1 UNION ALL SELECT b.fold, b.n, b.t, CASE WHEN b.t - s.rt >= {8 * HOUR_MS} THEN b.t ELSE s.rt END FROM n1 s JOIN n0 b ON b.fold = s.fold AND b.n = s.n + 1)"""


@query(f"WITH RECURSIVE {_TR}{_PLAN}, lf AS (SELECT *, CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END / vol AS raw FROM tr){_scaled_sql('lw', 'lf', 'raw')} SELECT tr.fold, tr.symbol, tr.t, round(lw.weight, 5) + 0.0 AS weight FROM tr JOIN n1 USING (fold, t) JOIN lw ON lw.fold = tr.fold AND lw.symbol = tr.symbol AND lw.t = rt")
def policy_buffered_long_flat(s, d):
    return _weights_out(pf.buffered_long_flat(_test_rows(s, d), ["fold"], 8 * HOUR_MS))


@query(f"WITH RECURSIVE {_TR}{_PLAN}, lf AS (SELECT *, CASE WHEN abs(score) > 0.5 THEN sign(score) ELSE 0.0 END / vol AS raw FROM tr){_scaled_sql('lw', 'lf', 'raw')} SELECT tr.fold, tr.symbol, tr.t, round(lw.weight, 5) + 0.0 AS weight FROM tr JOIN n1 USING (fold, t) JOIN lw ON lw.fold = tr.fold AND lw.symbol = tr.symbol AND lw.t = rt")
def policy_buffered_directional(s, d):
    return _weights_out(pf.buffered_directional(_test_rows(s, d), ["fold"], 8 * HOUR_MS, threshold=0.5))


@query(f"WITH RECURSIVE {_TR}{_sticky_sql('ska', 'score', 0.1, 8 * HOUR_MS, 1e-12)}{_sticky_sql('skb', 'carry_score', 0.1, 8 * HOUR_MS, 1e-12)} SELECT ska.fold, ska.symbol, ska.t, round(0.4 * ska.weight + 0.6 * skb.weight, 5) + 0.0 AS weight FROM ska JOIN skb USING (fold, symbol, t)")
def policy_two_sleeves(s, d):
    return _weights_out(pf.sleeves(_test_rows(s, d), ["fold"], {"score": 0.4, "carry_score": 0.6}, 0.1, 8 * HOUR_MS))


_THREE = "(SELECT *, (score + carry_score) / 2 AS mixed_score FROM"


@query(f"""WITH RECURSIVE {_TR.replace('tr AS (SELECT fold, symbol, t, score, carry_score,', 'tr AS (SELECT fold, symbol, t, score, carry_score, (score + carry_score) / 2 AS mixed_score,')}{_sticky_sql('ska', 'score', 0.1, 8 * HOUR_MS, 1e-12)}{_sticky_sql('skb', 'carry_score', 0.1, 8 * HOUR_MS, 1e-12)}{_sticky_sql('skc', 'mixed_score', 0.1, 8 * HOUR_MS, 1e-12)}{_PLAN},
  lf AS (SELECT *, CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END / vol AS raw FROM tr){_scaled_sql('lw', 'lf', 'raw')}
  SELECT ska.fold, ska.symbol, ska.t, round(0.3 * ska.weight + 0.3 * skb.weight + 0.4 * skc.weight, 5) + 0.0 AS core, round(0.75 * (0.3 * ska.weight + 0.3 * skb.weight + 0.4 * skc.weight) + 0.25 * lw.weight, 5) + 0.0 AS weight
  FROM ska JOIN skb USING (fold, symbol, t) JOIN skc USING (fold, symbol, t) JOIN n1 USING (fold, t) JOIN lw ON lw.fold = ska.fold AND lw.symbol = ska.symbol AND lw.t = rt""")
def policy_carry_regime(s, d):
    """Three sleeves (core), and with the regime's long-flat share."""
    rows = _test_rows(s, d).withColumn("mixed_score", (F.col("score") + F.col("carry_score")) / 2)
    shares = {"score": 0.3, "carry_score": 0.3, "mixed_score": 0.4}
    core = pf.sleeves(rows, ["fold"], shares, 0.1, 8 * HOUR_MS).select("fold", "symbol", "t", (F.round("weight", 5) + 0.0).alias("core"))
    return _weights_out(pf.carry_regime(rows, ["fold"], shares, "score", 0.25, 8 * HOUR_MS)).join(core, ["fold", "symbol", "t"])


@query()
def policy_pair_spread(s, d):
    train, test = _split(_pn(s, d, [*_USED, "log_close_level"]))
    m = staged(st.pair_models(train, "click", ["view", "error"], 120, 48)).withColumn("eligible", F.lit(True))
    legs = st.pair_legs(st.pair_spread_reversion(m, test, "click", 1.5, 24), "click")
    market = test.select("fold", "symbol", "t", F.col("realized_volatility_24h").alias("vol"))
    return pf.pair_spread(legs, market, ["fold"]).select("fold", "symbol", "t", (F.round("weight", 5) + 0.0).alias("weight"))


_BOOK = _TR + _sticky_sql("sk", "score", 0.1, 0, 0)
_POS = _BOOK + """, p0 AS (SELECT *, lag(weight, 1, 0) OVER q AS pw, lead(t) OVER q IS NULL AS lst FROM sk WINDOW q AS (PARTITION BY fold, symbol ORDER BY t)),
  po AS (SELECT *, abs(weight - pw) + CASE WHEN lst THEN abs(weight) ELSE 0 END AS trade, weight * ret AS price, -weight * funding_rate AS funding, CASE WHEN volume > 0 THEN 10000 * abs(weight - pw) / volume ELSE 0 END AS part FROM p0),
  ic0 AS (SELECT fold, t, row_number() OVER (PARTITION BY fold, t ORDER BY score, symbol) AS x, row_number() OVER (PARTITION BY fold, t ORDER BY outcome, symbol) AS y FROM tr), ic AS (SELECT fold, t, corr(x, y) AS rank_ic FROM ic0 GROUP BY 1, 2),
  cv0 AS (SELECT fold, t, sum(price) AS price_pnl, sum(funding) AS funding_pnl, sum(trade) * 0.0005 AS trading_fees, sum(trade) * 0.00005 AS spread_cost, sum(trade) * 0.0001 AS slippage_cost, sum(trade) AS turnover, sum(abs(weight)) AS gross_exposure, sum(weight) AS net_exposure, sum(weight * beta) AS beta_exposure, max(part) AS participation, max(regime) AS regime FROM po GROUP BY 1, 2),
  cv AS (SELECT *, price_pnl + funding_pnl - trading_fees - spread_cost - slippage_cost AS net_return FROM cv0 JOIN ic USING (fold, t))"""


def _positions(s, d) -> DataFrame:
    return bt.positions(staged(pf.neutral_long_short(_test_rows(s, d), ["fold"])))


def _curve(s, d) -> DataFrame:
    p = staged(_positions(s, d))
    rank = lambda c: F.row_number().over(wn.Window.partitionBy("fold", "t").orderBy(c, "symbol"))
    ic = p.withColumns({"x": rank("score"), "y": rank("outcome")}).groupBy("fold", "t").agg(F.corr("x", "y").alias("rank_ic"), F.max("regime").alias("regime"))
    return staged(bt.curve(p).join(ic, ["fold", "t"]))


_M = ("total_return", "annual_volatility", "sharpe", "max_drawdown", "hit_rate", "price_pnl", "funding_pnl", "trading_fees", "spread_cost", "slippage_cost", "turnover", "net_pnl", "annual_turnover", "mean_gross", "mean_net", "max_beta", "max_participation", "mean_rank_ic")


def _metrics_sql(by: str) -> str:
    return f""", eq AS (SELECT *, exp(sum(ln(1 + net_return)) OVER (PARTITION BY {by} ORDER BY t)) AS e FROM cm), dd AS (SELECT *, e / max(e) OVER (PARTITION BY {by} ORDER BY t) - 1 AS dn FROM eq),
  mt AS (SELECT {by}, count(*) AS n, exp(sum(ln(1 + net_return))) - 1 AS total_return, stddev_samp(net_return) * sqrt(8760) AS annual_volatility, avg(net_return) / stddev_samp(net_return) * sqrt(8760) AS sharpe, min(dn) AS max_drawdown, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, sum(price_pnl) AS price_pnl, sum(funding_pnl) AS funding_pnl,
    sum(trading_fees) AS trading_fees, sum(spread_cost) AS spread_cost, sum(slippage_cost) AS slippage_cost, sum(turnover) AS turnover, sum(net_return) AS net_pnl, sum(turnover) * 8760 / count(*) AS annual_turnover, avg(gross_exposure) AS mean_gross, avg(net_exposure) AS mean_net, max(abs(beta_exposure)) AS max_beta, max(participation) AS max_participation, avg(rank_ic) AS mean_rank_ic FROM dd GROUP BY {by})
  SELECT {by}, n, {', '.join(f'round({m}, 5) + 0.0 AS {m}' for m in _M)} FROM mt"""


def _metrics(c: DataFrame, by: str) -> DataFrame:
    return bt.curve_metrics(c, [by]).select(by, "n", *[(F.round(m, 5) + 0.0).alias(m) for m in _M])


@query(f"WITH RECURSIVE {_POS}, cm AS (SELECT * FROM cv){_metrics_sql('fold')}")
def metrics_by_fold(s, d):
    return _metrics(_curve(s, d), "fold")


@query(f"WITH RECURSIVE {_POS}, cm AS (SELECT *, strftime(make_date(1970, 1, 1) + CAST(t // 86400000 AS INTEGER), '%Y-%m') AS month FROM cv){_metrics_sql('month')}")
def metrics_by_month(s, d):
    return _metrics(_curve(s, d).withColumn("month", bt.month(F.col("t"))), "month")


@query(f"WITH RECURSIVE {_POS}, qq AS (SELECT quantile_cont(regime, 1.0 / 3) AS qa, quantile_cont(regime, 2.0 / 3) AS qb FROM cv), cm AS (SELECT * EXCLUDE (regime), CASE WHEN regime <= qa THEN 'low' WHEN regime <= qb THEN 'middle' ELSE 'high' END AS regime FROM cv, qq){_metrics_sql('regime')}")
def metrics_by_regime(s, d):
    from ..operators.aggregates import regime_buckets

    c = regime_buckets(_curve(s, d).withColumnRenamed("regime", "level"), "level")
    return _metrics(c, "regime")


@query(f"WITH RECURSIVE {_POS}, g AS (SELECT fold, symbol, sum(price) AS price_pnl, sum(funding) AS funding_pnl, sum(trade) AS trade_weight, sum(price) + sum(funding) - sum(trade) * 0.00065 AS net_contribution FROM po GROUP BY 1, 2) SELECT fold, symbol, round(price_pnl, 5) + 0.0 AS price_pnl, round(funding_pnl, 7) + 0.0 AS funding_pnl, round(trade_weight, 5) + 0.0 AS trade_weight, round(net_contribution, 5) + 0.0 AS net_contribution, round(abs(net_contribution) / sum(abs(net_contribution)) OVER (), 5) AS share FROM g")
def attribution(s, d):
    a = bt.attribution(_positions(s, d), ["fold", "symbol"])
    return a.select("fold", "symbol", *[(F.round(c, n) + 0.0).alias(c) for c, n in (("price_pnl", 5), ("funding_pnl", 7), ("trade_weight", 5), ("net_contribution", 5), ("share", 5))])


@query(f"""WITH RECURSIVE {_POS}, a0 AS (SELECT *, CASE WHEN abs(weight) > 1e-9 THEN sign(weight) ELSE 0 END AS side, CASE WHEN abs(pw) > 1e-9 THEN sign(pw) ELSE 0 END AS bef FROM po),
  a1 AS (SELECT *, lead(t) OVER q AS nt, lead(side) OVER q AS ns, CASE WHEN side <> bef AND side <> 0 THEN 1 ELSE 0 END AS nw FROM a0 WINDOW q AS (PARTITION BY fold, symbol ORDER BY t)), a2 AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY fold, symbol ORDER BY t) AS BIGINT) AS trade_no FROM a1),
  a3 AS (SELECT *, CASE WHEN nw = 1 THEN abs(weight) ELSE abs(weight - pw) END AS opened, CASE WHEN nt IS NULL OR ns <> side THEN abs(weight) ELSE 0 END AS closed FROM a2 WHERE side <> 0)
  SELECT fold, symbol, trade_no AS trade, CAST(max(side) AS DOUBLE) AS side, min(t) AS entry, last(coalesce(nt, t) ORDER BY t) AS "exit", last(CASE WHEN nt IS NULL THEN 'fold_close' WHEN ns = 0 THEN 'signal_exit' ELSE 'direction_flip' END ORDER BY t) AS exit_reason, round(sum(price), 5) + 0.0 AS price_return, round(sum(opened + closed), 5) AS turnover, round(sum(opened + closed) * 0.00065, 6) AS explicit_cost, count(*) AS n_rows FROM a3 GROUP BY 1, 2, 3""")
def trade_reconstruction(s, d):
    e = bt.trade_events(_positions(s, d), 1e-9)
    return e.select("fold", "symbol", "trade", "side", "entry", "exit", "exit_reason", (F.round("price_return", 5) + 0.0).alias("price_return"), F.round("turnover", 5).alias("turnover"), F.round("explicit_cost", 6).alias("explicit_cost"), "n_rows")


@query(f"""WITH RECURSIVE {_POS}, dy AS (SELECT CAST(make_date(1970, 1, 1) + CAST(t // 86400000 AS INTEGER) AS DATE) AS day, exp(sum(ln(1 + net_return))) - 1 AS net_return FROM cv GROUP BY 1),
  rs AS (SELECT day, net_return, CASE WHEN count(*) OVER w = 5 AND stddev_samp(net_return) OVER w > 1e-15 THEN avg(net_return) OVER w / stddev_samp(net_return) OVER w * sqrt(365) END AS sharpe FROM dy WINDOW w AS (ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT day, round(net_return, 6) + 0.0 AS net_return, round(sharpe, 4) + 0.0 AS sharpe FROM rs""")
def rolling_sharpe(s, d):
    r = bt.rolling_sharpe(bt.daily(_curve(s, d)), 5)
    return r.select("day", (F.round("net_return", 6) + 0.0).alias("net_return"), (F.round("sharpe", 4) + 0.0).alias("sharpe"))


_TWO = _TR + _sticky_sql("ska", "score", 0.1, 0, 0) + _sticky_sql("skb", "carry_score", 0.1, 0, 0)


def _two(s, d) -> tuple[DataFrame, DataFrame]:
    rows = _test_rows(s, d)
    return tuple(staged(pf.neutral_long_short(rows, ["fold"], score=c)) for c in ("score", "carry_score"))


@query(f"""WITH RECURSIVE {_TWO},
  j AS (SELECT t, coalesce(ska.weight, 0) AS x, coalesce(skb.weight, 0) AS y FROM ska FULL JOIN skb USING (fold, symbol, t)),
  g AS (
    SELECT t, sum(x * y) AS xy, sqrt(sum(x * x)) AS nx, sqrt(sum(y * y)) AS ny, least(sum(abs(x)), sum(abs(y))) AS gross,
      sum(CASE WHEN x * y > 0 THEN least(abs(x), abs(y)) ELSE 0 END) AS same, sum(CASE WHEN x * y < 0 THEN least(abs(x), abs(y)) ELSE 0 END) AS opposite FROM j GROUP BY t),
  a AS (SELECT *, nx > 1e-12 AND ny > 1e-12 AND gross > 1e-12 AS active FROM g)
  SELECT count_if(active) AS n, round(avg(xy / (nx * ny)) FILTER (active), 5) AS mean_cosine, round(median(xy / (nx * ny)) FILTER (active), 5) AS median_cosine,
    round(avg(same / gross) FILTER (active), 5) AS same_direction, round(avg(opposite / gross) FILTER (active), 5) AS opposite_direction, round(avg((same + opposite) / gross) FILTER (active), 5) AS overlap FROM a""")
def position_similarity(s, d):
    p = bt.position_similarity(*_two(s, d))
    return p.select("n", *[F.round(c, 5).alias(c) for c in ("mean_cosine", "median_cosine", "same_direction", "opposite_direction", "overlap")])


@query(f"""WITH RECURSIVE {_TWO}, al AS (SELECT 'a' AS sleeve, fold, symbol, t, ret, 0.6 * weight AS w FROM ska UNION ALL SELECT 'b', fold, symbol, t, ret, 0.4 * weight FROM skb),
  mv AS (SELECT *, abs(w - lag(w, 1, 0) OVER q) + CASE WHEN lead(t) OVER q IS NULL THEN abs(w) ELSE 0 END AS trade FROM al WINDOW q AS (PARTITION BY fold, sleeve, symbol ORDER BY t)), ap AS (SELECT fold, t, sum(trade) AS st, sum(w * ret) AS pnl FROM mv GROUP BY 1, 2),
  on0 AS (SELECT fold, t, symbol, sum(w) AS w FROM al GROUP BY 1, 2, 3), on1 AS (SELECT *, abs(w - lag(w, 1, 0) OVER q) + CASE WHEN lead(t) OVER q IS NULL THEN abs(w) ELSE 0 END AS trade FROM on0 WINDOW q AS (PARTITION BY fold, symbol ORDER BY t)), on2 AS (SELECT fold, t, sum(trade) AS nt FROM on1 GROUP BY 1, 2)
  SELECT fold, t, round(st, 5) AS sleeve_turnover, round(nt, 5) AS netted_turnover, round(st - nt, 5) + 0.0 AS offset_, round((st - nt) * 0.00065, 7) + 0.0 AS savings, round(pnl - nt * 0.00065, 6) + 0.0 AS netted_net FROM ap JOIN on2 USING (fold, t)""")
def netted_portfolio(s, d):
    a, b = _two(s, d)
    part = lambda x, n, k: x.select(F.lit(n).alias("sleeve"), F.lit(k).alias("share"), "fold", "t", "symbol", "weight", "ret")
    r = bt.netted(part(a, "a", 0.6).union(part(b, "b", 0.4)))
    return r.select("fold", "t", F.round("sleeve_turnover", 5).alias("sleeve_turnover"), F.round("netted_turnover", 5).alias("netted_turnover"), (F.round("offset", 5) + 0.0).alias("offset_"), (F.round("savings", 7) + 0.0).alias("savings"), (F.round("netted_net", 6) + 0.0).alias("netted_net"))


def _trials(s, d) -> DataFrame:
    """A trial a symbol: its hourly returns, at times that all have."""
    p = _pn(s, d, _USED)
    return br.complete_times(p, 5).select(F.col("symbol").alias("trial"), "t", (F.col("log_return_1h") / 100).alias("net_return"))


_TRIALS = _PN + ", ok AS (SELECT t FROM pn GROUP BY t HAVING count(*) = 5), trials AS (SELECT symbol AS trial, t, log_return_1h / 100 AS net_return FROM pn WHERE t IN (SELECT t FROM ok)), stt AS (SELECT trial, count(*) AS n, exp(sum(ln(1 + net_return))) - 1 AS total_return, avg(net_return) / stddev_samp(net_return) * sqrt(8760) AS sharpe FROM trials GROUP BY 1)"


@query()
def bootstrap(s, d):
    r = _trials(s, d).where("trial = 'click'")
    return va.bootstrap_summary(va.block_bootstrap(r, "net_return", "t", 200))


@query()
def deflated_sharpe(s, d):
    return va.deflated_sharpe_of(_trials(s, d))


@query(f"""WITH {_TRIALS}, dl AS (SELECT CAST(make_date(1970, 1, 1) + CAST(t // 86400000 AS INTEGER) AS DATE) AS day, exp(sum(ln(1 + net_return)) FILTER (trial = 'click')) - 1 AS x, exp(sum(ln(1 + net_return)) FILTER (trial = 'view')) - 1 AS y FROM trials GROUP BY 1),
  sd AS (SELECT stddev_samp(x) AS a, stddev_samp(y) AS b, count(*) AS n FROM dl), mx AS (SELECT day, unnest(['champion', 'scaled', 'inverse']) AS mix, unnest([x, 0.8 * x + 0.2 * y * a / b, (x / a + y / b) / (1 / a + 1 / b)]) AS r FROM dl, sd),
  me AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY mix ORDER BY day)) AS e FROM mx), md AS (SELECT *, e / max(e) OVER (PARTITION BY mix ORDER BY day) - 1 AS dn FROM me), ms AS (SELECT mix, count(*) AS n, exp(sum(ln(1 + r))) - 1 AS tr, avg(r) / stddev_samp(r) * sqrt(365) AS sh, min(dn) AS mdd FROM md GROUP BY mix)
  SELECT max(n) AS overlap_days, round(max(tr) FILTER (mix = 'champion'), 6) AS champion_total_return, round(max(tr) FILTER (mix = 'scaled'), 6) AS scaled_total_return, round(max(sh) FILTER (mix = 'inverse'), 4) AS inverse_sharpe, round(max(sh) FILTER (mix = 'scaled') - max(sh) FILTER (mix = 'champion'), 4) AS sharpe_increment,
  round((abs(max(mdd) FILTER (mix = 'champion')) - abs(max(mdd) FILTER (mix = 'scaled'))) / abs(max(mdd) FILTER (mix = 'champion')), 4) AS drawdown_reduction FROM ms""")
def blend_metrics(s, d):
    from ..functions.columns import utc_date

    of = lambda k: F.expm1(F.sum(F.when(F.col("trial") == k, F.log1p("net_return"))))
    daily = _trials(s, d).groupBy(utc_date(F.col("t")).alias("day")).agg(of("click").alias("champion"), of("view").alias("candidate"))
    b = va.blend_metrics(daily, least=5)
    return b.select("overlap_days", *[F.round(c, n).alias(c) for c, n in (("champion_total_return", 6), ("scaled_total_return", 6), ("inverse_sharpe", 4), ("sharpe_increment", 4), ("drawdown_reduction", 4))])


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


@query("SELECT DISTINCT c_custkey AS campaign_id, c_name FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE p_brand = 'Brand#11'")
def campaigns_using(s, d):
    f = _t(s, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_brand").alias("name"))
    links = _t(s, d, "lineitem").select(F.col("l_partkey").alias("feature_id"), F.col("l_orderkey").alias("experiment_id"))
    e = _t(s, d, "orders").select(F.col("o_orderkey").alias("experiment_id"), F.col("o_custkey").alias("campaign_id"))
    return rg.users_of(f, links, e, _t(s, d, "customer").select(F.col("c_custkey").alias("campaign_id"), "c_name"), "Brand#11")


@query("SELECT o_orderkey AS experiment_id, EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_brand = 'Brand#11') AS used FROM orders")
def experiment_uses(s, d):
    f = _t(s, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_brand").alias("name"))
    links = _t(s, d, "lineitem").select(F.col("l_partkey").alias("feature_id"), F.col("l_orderkey").alias("experiment_id"))
    return rg.uses(_t(s, d, "orders").select(F.col("o_orderkey").alias("experiment_id")), links, f, "Brand#11")


@query("SELECT l_orderkey AS experiment_id, max(l_linenumber) AS attempt, arg_max(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS run_id FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def latest_success(s, d):
    r = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("experiment_id"), F.col("l_partkey").alias("run_id"), F.col("l_linenumber").alias("attempt"), F.col("l_linestatus").alias("status"))
    return rg.latest_success(r, "F")


@query("""WITH r AS (SELECT o_orderkey AS run_id, o_orderstatus AS st, coalesce(CASE WHEN o_custkey % 3 = 0 THEN date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) END, CASE WHEN o_custkey % 3 = 1 THEN date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) - 1 END, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) - 2) AS seen FROM orders)
  SELECT run_id, CASE WHEN st IN ('O', 'P') AND seen < 10000 THEN 'STALE' ELSE st END AS status, st IN ('O', 'P') AND seen < 10000 AS was_stale FROM r""")
def stale_runs(s, d):
    day = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))
    k = F.col("o_custkey") % 3
    r = _t(s, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.when(k == 0, day).alias("heartbeat"), F.when(k == 1, day - 1).alias("started"), (day - 2).alias("created"))
    return rg.stale(r, 10000, ("O", "P")).select("run_id", "status", "was_stale")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT') AND o_orderkey + 10 >= 100 AND o_orderkey <= 5000 ORDER BY 1")
def listed_files(s, d):
    o = _t(s, d, "orders").withColumns({"start_t": F.col("o_orderkey"), "end_t": F.col("o_orderkey") + 10})
    return rg.listed(o, {"o_orderstatus": ["O", "F"], "o_orderpriority": ["1-URGENT"], "o_clerk": None}, 100, 5000, order=("o_orderkey",)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT DISTINCT event_type AS symbol, CAST(unnest(generate_series(DATE '2024-01-05', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS day FROM events EXCEPT SELECT event_type, CAST(ts AS DATE) FROM events WHERE user_id = 1")
def backfill_targets(s, d):
    e = _events(s, d)
    have = e.where("user_id = 1").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day")).distinct()
    return rg.backfill_targets(e.select(F.col("event_type").alias("symbol")), "2024-01-05", "2024-01-31", "2024-01-20", have)


@query("""WITH g AS (SELECT a, b, abs(a + b - 1) <= 1e-9 AS ok, sha256(concat_ws(chr(31), CAST(a AS VARCHAR), CAST(b AS VARCHAR))) AS trial_id FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75]::DOUBLE[]) AS a), (SELECT unnest([0.25, 0.5, 1.0]::DOUBLE[]) AS b)) SELECT a, b, trial_id, (SELECT count(*) FROM g WHERE NOT ok) AS rejected, CAST(row_number() OVER (ORDER BY trial_id) AS INTEGER) AS ordinal FROM g WHERE ok""")
def trial_plan(s, d):
    grid = jn.parameter_grid(s, {"a": [0.0, 0.25, 0.5, 0.75], "b": [0.25, 0.5, 1.0]}).drop("ordinal")
    return rg.trial_plan(grid, F.abs(F.col("a") + F.col("b") - 1) <= 1e-9, ["a", "b"])


#: Faults planted in a curve by the number of a row's hour: a row twice, a fold out of order, no number, a wrong sum.
_BENT = {"twice": "h % 50 = 1", "fold": "h % 60 = 2", "nan": "h % 70 = 3", "wrong": "h % 80 = 4"}


@query(f"""WITH RECURSIVE {_POS},
  b0 AS (
    SELECT t, t // {HOUR_MS} AS h, fold, price_pnl + funding_pnl - trading_fees - spread_cost - slippage_cost AS net, net_return,
      unnest(CASE WHEN t // {HOUR_MS} % 50 = 1 THEN [1, 2] ELSE [1] END) AS k FROM cv),
  b1 AS (
    SELECT t, CASE WHEN {_BENT["fold"]} THEN -1 ELSE fold END AS fold, k, net_return + CASE WHEN {_BENT["wrong"]} THEN 1e-9 ELSE 0 END AS r, net, {_BENT["nan"]} AS bad FROM b0),
  b2 AS (SELECT *, lag(t) OVER (ORDER BY t, fold, k) AS pt, lag(fold) OVER (ORDER BY t, fold, k) AS pf FROM b1)
  SELECT count(*) AS n_rows, count_if(coalesce(t = pt, false)) AS repeated_times, count_if(coalesce(fold < pf, false)) AS unordered_folds, count_if(bad) AS not_finite,
    count_if(bad OR abs(r - net) > 1e-12) AS unreconciled FROM b2""")
def curve_contract(s, d):
    c = _curve(s, d).withColumn("h", F.floor(F.col("t") / HOUR_MS))
    c = c.withColumns({
        "fold": F.when(F.expr(_BENT["fold"]), -1).otherwise(F.col("fold")), "price_pnl": F.when(F.expr(_BENT["nan"]), float("nan")).otherwise(F.col("price_pnl")),
        "net_return": F.col("net_return") + F.when(F.expr(_BENT["wrong"]), 1e-9).otherwise(0.0),
    })
    c = c.withColumn("k", F.explode(F.when(F.expr(_BENT["twice"]), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return bt.curve_faults(c)


@query(f"WITH RECURSIVE {_POS} SELECT CAST(make_date(1970, 1, 1) + CAST(t // 86400000 AS INTEGER) AS DATE) AS day, symbol, round(avg(weight), 5) + 0.0 AS mean_weight, round(sum(trade), 5) + 0.0 AS turnover FROM po GROUP BY 1, 2")
def daily_positions(s, d):
    return bt.daily_positions(_positions(s, d)).select("day", "symbol", (F.round("mean_weight", 5) + 0.0).alias("mean_weight"), (F.round("turnover", 5) + 0.0).alias("turnover"))


@query(f"WITH {_FEAT}, j AS (SELECT a.log_return_1h AS x, b.log_return_1h AS y FROM ft a JOIN ft b ON a.t = b.t AND a.symbol = 'click' AND b.symbol = 'view' WHERE a.quote_volume_1h > 0 AND b.quote_volume_1h > 0 AND a.log_return_1h IS NOT NULL AND b.log_return_1h IS NOT NULL) SELECT count(*) AS n, round(corr(x, y), 6) AS correlation FROM j")
def masked_correlation(s, d):
    x = _features(s, d, ["log_return_1h", "quote_volume_1h"]).withColumn("ok", (F.col("quote_volume_1h") > 0) & F.col("log_return_1h").isNotNull())
    side = lambda k: x.where(F.col("symbol") == k).select("t", F.lit("x").alias("symbol"), "log_return_1h", "ok")
    return _round(jn.masked_correlation(side("click"), side("view"), "log_return_1h", "ok"), "correlation")


_WIRE = """WITH m AS (SELECT event_id, event_type, value, CASE WHEN event_id % 11 = 0 THEN 'symbol' WHEN event_id % 19 = 0 THEN 'event type' WHEN event_id % 13 = 0 THEN 'field p' WHEN event_id % 17 = 0 THEN 'field m' END AS why FROM events WHERE event_id % 23 <> 0)"""


@query(f"{_WIRE} SELECT 'aggregate_trades' AS kind, upper(event_type) AS symbol, coalesce(why, 'accepted') AS outcome, count(*) AS n, round(sum(CASE WHEN why IS NULL THEN value END), 4) AS total FROM m GROUP BY 2, 3")
def wire_trades(s, d):
    """Events as trade messages, some of them faulty or acknowledgements, parsed with the reasons of their rejection."""
    from ..sources import wire

    e, k = _events(s, d), F.col("event_id")
    data = F.struct(
        F.when((k % 19 == 0), "trade").otherwise("aggTrade").alias("e"), k.alias("E"), F.when(k % 11 == 0, "OTHER").otherwise(F.upper("event_type")).alias("s"), k.alias("a"),
        F.when(k % 13 == 0, "NaN").otherwise(F.col("value").cast("string")).alias("p"), F.lit("1").alias("q"), k.alias("f"), k.alias("l"), k.alias("T"), F.when(k % 17 != 0, F.lit(True)).alias("m"),
    )
    text = F.when(k % 23 == 0, F.lit('{"result": null, "id": 1}')).otherwise(F.to_json(F.struct(F.concat("event_type", F.lit("@aggTrade")).alias("stream"), data.alias("data"))))
    p = wire.parse(e.select(text.alias("value")))
    g = p.groupBy("kind", "symbol", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("reject_reason").isNull(), F.col("aggregate_trades.price"))), 4).alias("total"))
