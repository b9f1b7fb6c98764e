"""A campaign of trials over the panel of queries.py, and what validation says of it.

A trial holds ranks of the symbols by their last ``lookback`` returns, taken anew every ``hold`` hours, for the next
hour's return. Every figure of a trial follows from its positions, so the gates and rules meet real facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS, HOUR_MS
from ..operators import backtest as bt
from ..operators import validation as va
from ..operators import windows as wn
from ..sources.files import staged
from .queries import _PANEL, START, _panel, query

LOOKBACKS, HOLDS, FOLD_MS = (1, 2, 4, 8), (1, 6, 24), 7 * DAY_MS
COSTS = bt.Costs()
RATE = sum(COSTS.rates().values())


def _rows(s, d) -> DataFrame:
    """trial, lookback, hold, fold, symbol, t, weight, ret."""
    p = wn.with_halo(_panel(s, d).select("symbol", "t", "ret", "score"), max(LOOKBACKS), 1)
    w = wn.by_symbol(p)
    sums = {f"s{n}": wn.trailing_sum(F.col("score"), n, 0, w) for n in LOOKBACKS}
    p = wn.own(p.withColumns(sums | {"ret": F.lead("ret").over(w)})).where(f"s{max(LOOKBACKS)} IS NOT NULL AND ret IS NOT NULL")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("lookback"), F.col(f"s{n}").alias("score")) for n in LOOKBACKS]))
    p = p.select("symbol", "t", "ret", each.alias("x")).select("symbol", "t", "ret", "x.*")
    at = Window.partitionBy("lookback", "t")
    p = p.withColumn("c", F.row_number().over(at.orderBy("score", "symbol")) - (F.count("*").over(at) + 1) / 2)
    p = p.withColumn("w", F.coalesce(F.try_divide("c", F.sum(F.abs("c")).over(at)), F.lit(0.0)))
    p = p.withColumn("hold", F.explode(F.array(*map(F.lit, HOLDS))))
    p = p.withColumn("w", F.when(F.floor(F.col("t") / HOUR_MS) % F.col("hold") == 0, F.col("w")))
    p = wn.carried(p, "w", "held", ["lookback", "hold", "symbol"], width=7 * DAY_MS)
    trial = F.format_string("b%dh%02d", "lookback", "hold")
    fold = F.floor((F.col("t") - START) / FOLD_MS).cast("int")
    return p.select(trial.alias("trial"), "lookback", "hold", fold.alias("fold"), "symbol", "t", F.coalesce("held", F.lit(0.0)).alias("weight"), "ret")


def _accounts(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, positions and curves of all trials in one pass: positions know a trial's fold as a fold of its own."""
    rows = staged(_rows(s, d))
    key = F.struct("trial", "fold").alias("fold")
    positions = staged(bt.positions(rows.select(key, "symbol", "t", "weight", "ret"), COSTS))
    curves = staged(bt.curve(positions).select("fold.trial", "fold.fold", "t", "net_return", "price_pnl", "turnover"))
    return rows, positions.select("fold.trial", "fold.fold", "symbol", "t", "net_contribution"), curves


_CV = f"""{_PANEL},
  sg AS (
    SELECT symbol, t, lead(ret) OVER s AS ret,
      {", ".join(f"CASE WHEN count(score) OVER w{n} = {n} THEN sum(score) OVER w{n} END AS s{n}" for n in LOOKBACKS)}
    FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY t),
      {", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in LOOKBACKS)}),
  lb AS (
    SELECT symbol, t, ret, unnest([{", ".join(map(str, LOOKBACKS))}]) AS lookback, unnest([{", ".join(f"s{n}" for n in LOOKBACKS)}]) AS score
    FROM sg WHERE s{max(LOOKBACKS)} IS NOT NULL AND ret IS NOT NULL),
  ce AS (
    SELECT *, row_number() OVER (PARTITION BY lookback, t ORDER BY score, symbol) - (count(*) OVER (PARTITION BY lookback, t) + 1) / 2.0 AS c FROM lb),
  un AS (
    SELECT *, coalesce(c / nullif(sum(abs(c)) OVER (PARTITION BY lookback, t), 0), 0) AS w, unnest([{", ".join(map(str, HOLDS))}]) AS hold FROM ce),
  hd AS (
    SELECT *, 'b' || lookback || 'h' || lpad(CAST(hold AS VARCHAR), 2, '0') AS trial, (t - {START}) // {FOLD_MS} AS fold,
      coalesce(last_value(CASE WHEN t // {HOUR_MS} % hold = 0 THEN w END IGNORE NULLS) OVER (
        PARTITION BY lookback, hold, symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS weight FROM un),
  lg AS (
    SELECT *, lag(weight, 1, 0) OVER f AS before, lead(t) OVER f IS NULL AS last FROM hd WINDOW f AS (PARTITION BY trial, fold, symbol ORDER BY t)),
  tr AS (
    SELECT *, abs(weight - before) + CASE WHEN last THEN abs(weight) ELSE 0 END AS trade,
      abs(before - lag(before, 1, 0) OVER f) + CASE WHEN last THEN abs(before) ELSE 0 END AS late_trade
    FROM lg WINDOW f AS (PARTITION BY trial, fold, symbol ORDER BY t)),
  cv AS (
    SELECT trial, fold, t, sum(weight * ret) AS pnl, sum(trade) AS turnover, sum(weight * ret) - sum(trade) * {RATE!r} AS net,
      sum(weight * ret) - sum(trade) * {1.5 * RATE!r} AS net15, sum(before * ret) - sum(late_trade) * {RATE!r} AS net_late FROM tr GROUP BY ALL),
  eq AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY trial ORDER BY t)) AS e FROM cv),
  dn AS (SELECT *, e / max(e) OVER (PARTITION BY trial ORDER BY t) - 1 AS d FROM eq),
  ss AS (
    SELECT trial, count(*) AS n, exp(sum(ln(1 + net))) - 1 AS total_return, avg(net) / stddev_samp(net) * sqrt(8760) AS sharpe, min(d) AS max_drawdown,
      exp(sum(ln(1 + net15))) - 1 AS stress_cost, exp(sum(ln(1 + net_late))) - 1 AS stress_late, sum(turnover) AS turnover, sum(pnl) AS pnl
    FROM dn GROUP BY trial),
  st AS (SELECT *, row_number() OVER (ORDER BY sharpe DESC NULLS LAST, trial) AS place FROM ss),
  fo AS (SELECT trial, fold, exp(sum(ln(1 + net))) - 1 AS x FROM cv GROUP BY ALL),
  fs AS (SELECT trial, count(*) AS folds, count_if(x > 0) AS folds_won, min(x) AS worst_fold FROM fo GROUP BY trial),
  sp AS (SELECT trial, max(abs(x)) / sum(abs(x)) AS span_share FROM (SELECT trial, t // {DAY_MS} AS day, sum(net) AS x FROM cv GROUP BY ALL) GROUP BY trial),
  sy AS (SELECT trial, max(abs(x)) / sum(abs(x)) AS symbol_share FROM (SELECT trial, symbol, sum(weight * ret) - sum(trade) * {RATE!r} AS x FROM tr GROUP BY ALL) GROUP BY trial),
  wd AS (SELECT * FROM st JOIN fs USING (trial) JOIN sp USING (trial) JOIN sy USING (trial)),
  fc AS (
    SELECT trial, unnest(['total_return', 'sharpe', 'max_drawdown', 'place', 'folds', 'folds_won', 'worst_fold', 'span_share', 'symbol_share', 'stress:cost_x1.5', 'stress:delay_1']) AS fact,
      unnest([total_return, sharpe, max_drawdown, place, folds, folds_won, worst_fold, span_share, symbol_share, stress_cost, stress_late]) AS value FROM wd),
  pm AS (SELECT trial, sharpe, CAST(ascii(substr(trial, 2, 1)) - 48 AS DOUBLE) AS lookback, CAST(substr(trial, 4) AS DOUBLE) AS hold FROM st),
  be AS (SELECT * FROM pm ORDER BY sharpe DESC NULLS LAST, trial LIMIT 1),
  rg AS (SELECT max(lookback) - min(lookback) AS rl, max(hold) - min(hold) AS rh FROM pm),
  nb AS (
    SELECT pm.trial, pm.sharpe, sqrt(pow((pm.lookback - be.lookback) / rl, 2) + pow((pm.hold - be.hold) / rh, 2)) AS dist, be.trial AS best, be.sharpe AS bs
    FROM pm, be, rg WHERE pm.trial <> be.trial ORDER BY dist, pm.trial LIMIT 3)"""


def _parameters(rows: DataFrame) -> DataFrame:
    return rows.select("trial", F.col("lookback").cast("double").alias("lookback"), F.col("hold").cast("double").alias("hold")).distinct()


def _stats(s, d) -> DataFrame:
    rows, _, curves = _accounts(s, d)
    return va.return_statistics(curves, ["trial"], "net_return", "t").join(_parameters(rows), "trial")


def _facts(s, d) -> DataFrame:
    rows, positions, curves = _accounts(s, d)
    stressed = bt.stress(rows, [1.5], COSTS, by=("trial",))
    return va.trial_facts(curves, positions, stressed, F.floor(F.col("t") / DAY_MS))


@query(f"WITH {_CV} SELECT trial, fact, round(value, 5) + 0.0 AS value FROM fc")
def campaign_facts(s, d):
    return _facts(s, d).withColumn("value", F.round("value", 5) + 0.0)


_RULES = [
    ("best of its campaign", "place", "value <= 1"),
    ("gains after costs", "total_return", "value > 0"),
    ("gains at half more costs", "stress:cost_x1.5", "value > 0"),
    ("gains a bar late", "stress:delay_1", "value > 0"),
    ("gains in several folds", "folds_won", "value >= 2"),
    ("not by one span", "span_share", "value <= 0.5"),
    ("not by one symbol", "symbol_share", "value <= 0.7"),
    ("neighbours gain too", "neighbours_positive", "value >= 0.5"),
]


@query(f"""WITH {_CV},
  all_facts AS (
    SELECT trial, fact, value FROM fc UNION ALL
    SELECT max(best), 'neighbours_positive', avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0.0 END) FROM nb),
  ru(rule, fact) AS (VALUES {", ".join(f"('{r}', '{f}')" for r, f, _ in _RULES)}),
  ju AS (
    SELECT s.trial, ru.rule, a.value, coalesce(CASE ru.fact {" ".join(f"WHEN '{f}' THEN {c}" for _, f, c in _RULES)} END, false) AS passed
    FROM (SELECT DISTINCT trial FROM fc) s, ru LEFT JOIN all_facts a ON a.trial = s.trial AND a.fact = ru.fact)
  SELECT trial, rule, round(value, 5) + 0.0 AS value, passed, bool_and(passed) OVER (PARTITION BY trial) AS all_passed FROM ju""")
def candidate_gates(s, d):
    near = va.neighbourhood(_stats(s, d), ["lookback", "hold"])
    near = near.select(F.col("best").alias("trial"), F.lit("neighbours_positive").alias("fact"), F.col("positive_share").alias("value"))
    rules = tuple(r for r in va.CANDIDATE if r.name in {x[0] for x in _RULES})
    return va.judged(_facts(s, d).unionByName(near), rules).withColumn("value", F.round("value", 5) + 0.0)


@query()
def campaign_robustness(s, d):
    """The whole campaign, with the best trial judged by what only a campaign knows, too."""
    rows, _, curves = _accounts(s, d)
    r = staged(va.campaign_robustness(curves, _parameters(rows), ["lookback", "hold"]))
    luck = va.judged(va.campaign_facts(r), tuple(x for x in va.CANDIDATE if x.name not in {y[0] for y in _RULES}))
    passed = luck.groupBy(F.col("trial").alias("best")).agg(F.array_sort(F.collect_list(F.when(F.col("passed"), F.col("rule")))).alias("luck_passed"))
    return r.join(passed, "best")


@query()
def overfitting_probability(s, d):
    return va.overfitting_probability(_accounts(s, d)[2])


@query(f"""WITH {_CV} SELECT max(best) AS best, string_agg(trial, ',' ORDER BY dist, trial) AS nearest, count(*) AS neighbours, round(median(sharpe), 4) AS median_sharpe,
  round(avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0.0 END), 4) AS positive_share, round(max(bs) - median(sharpe), 4) AS gap FROM nb""")
def parameter_neighbourhood(s, d):
    n = va.neighbourhood(_stats(s, d), ["lookback", "hold"])
    return n.select("best", F.concat_ws(",", "nearest").alias("nearest"), "neighbours", *[F.round(c, 4).alias(c) for c in ("median_sharpe", "positive_share", "gap")])


@query(f"SELECT * FROM (WITH {_CV} SELECT trial, round(sharpe, 5) AS sharpe FROM st ORDER BY sharpe DESC NULLS LAST, trial LIMIT 1)")
def best_trial(s, d):
    return va.best_trial(_stats(s, d)).select("trial", F.round("sharpe", 5).alias("sharpe"))


@query(f"""WITH {_CV} SELECT trial, name, round(value, 5) AS value, 'trial' AS scope
  FROM (SELECT trial, CAST(n AS DOUBLE) AS n, total_return, sharpe FROM st) UNPIVOT (value FOR name IN (n, total_return, sharpe))""")
def metrics_long(s, d):
    return va.metrics_long(_stats(s, d).select("trial", "n", "total_return", "sharpe"), ["trial"], "trial").withColumn("value", F.round("value", 5))


@query(f"WITH {_CV} SELECT trial, round(sharpe, 5) AS sharpe, round(total_return, 5) AS total_return, CAST(place AS INTEGER) AS rank FROM st")
def compare_trials(s, d):
    long_ = va.metrics_long(_stats(s, d).select("trial", "total_return", "sharpe"), ["trial"], "trial")
    return va.compare_trials(long_, ["sharpe", "total_return"]).select("trial", F.round("sharpe", 5).alias("sharpe"), F.round("total_return", 5).alias("total_return"), "rank")


@query(f"""WITH {_CV},
  xy AS (SELECT c.trial, c.net AS y, b.net AS x FROM cv c JOIN (SELECT t, net FROM cv WHERE trial = (SELECT trial FROM be)) b USING (t) WHERE c.trial <> (SELECT trial FROM be)),
  ab AS (SELECT trial, stddev_samp(x) AS a, stddev_samp(y) AS b, corr(x, y) AS correlation FROM xy GROUP BY trial),
  bl AS (
    SELECT trial, max(correlation) AS correlation, avg(0.8 * x + 0.2 * y * a / b) / stddev_samp(0.8 * x + 0.2 * y * a / b) * sqrt(8760) - avg(x) / stddev_samp(x) * sqrt(8760) AS sharpe_increment
    FROM xy JOIN ab USING (trial) GROUP BY trial),
  wv AS (
    SELECT trial, round(correlation, 5) AS correlation, round(sharpe_increment, 5) AS sharpe_increment, coalesce(sharpe >= 0.5 AND max_drawdown >= -0.25 AND stress_cost > 0, false) AS standalone,
      coalesce(abs(correlation) <= 0.3 AND sharpe_increment > 0 AND total_return > 0, false) AS diversifier FROM st JOIN bl USING (trial))
  SELECT *, CASE WHEN standalone THEN 'standalone' WHEN diversifier THEN 'diversifier' ELSE 'rejected' END AS class FROM wv""")
def wave_gates(s, d):
    rows, _, curves = _accounts(s, d)
    stats = staged(va.return_statistics(curves, ["trial"], "net_return", "t"))
    stress = bt.stress(rows, [1.5], COSTS, full=False, by=("trial",)).select("trial", F.col("total_return").alias("cost_1_5x_return"))
    beside = va.beside_champion(curves, va.best_trial(stats))
    out = va.wave_gates(stats.join(stress, "trial").join(beside, "trial"))
    return out.select("trial", F.round("correlation", 5).alias("correlation"), F.round("sharpe_increment", 5).alias("sharpe_increment"), "standalone", "diversifier", "class")


@query(f"""WITH {_CV},
  pr AS (SELECT a.trial AS w, b.trial AS o, CAST(a.hold AS INTEGER) AS hold FROM pm a JOIN pm b ON a.lookback = b.lookback AND a.hold > 1 AND b.hold = 1),
  im AS (SELECT w, count_if(f.x > g.x) AS folds FROM pr JOIN fo f ON f.trial = w JOIN fo g ON g.trial = o AND g.fold = f.fold GROUP BY w),
  ds AS (
    SELECT w AS with_trial, o AS without_trial, a.sharpe - b.sharpe AS ds, a.total_return - b.total_return AS dr, a.turnover - b.turnover AS dt, a.pnl - b.pnl AS dg, a.stress_cost AS stress, folds
    FROM pr JOIN st a ON a.trial = w JOIN st b ON b.trial = o JOIN im USING (w))
  SELECT with_trial, without_trial, round(ds, 5) AS delta_sharpe, round(dr, 6) AS delta_total_return, round(dt, 5) AS delta_turnover,
    CASE WHEN ds > 0 AND dr > 0 AND folds >= 1 AND stress > 0 THEN 'supported' WHEN dg > 0 AND dr < 0 AND dt > 0 THEN 'rejected_costs'
      WHEN ds <= 0 AND dr <= 0 THEN 'rejected' ELSE 'inconclusive' END AS decision FROM ds""")
def ablation(s, d):
    """The feature is holding for longer than an hour."""
    rows, positions, curves = _accounts(s, d)
    facts = _facts(s, d).groupBy("trial").pivot("fact", ["total_return", "sharpe", "max_drawdown", "span_share", "stress:cost_x1.5"]).agg(F.max("value"))
    sums = curves.groupBy("trial").agg(F.sum("turnover").alias("turnover"), F.sum("price_pnl").alias("gross_pnl")).withColumn("cost", F.col("turnover") * RATE)
    zero = {c: F.lit(0.0) for c in ("rank_ic", "participation")}
    metrics = facts.join(sums, "trial").withColumnsRenamed({"span_share": "month_concentration", "stress:cost_x1.5": "cost_1_5x_return"}).withColumns(zero)
    p = _parameters(rows)
    base = p.where("hold = 1").select(F.col("trial").alias("without_trial"), "lookback")
    pairs = p.where("hold > 1").select(F.col("trial").alias("with_trial"), "lookback", F.format_string("hold %d", F.col("hold").cast("int")).alias("feature")).join(base, "lookback")
    folds = curves.groupBy("trial", "fold").agg(F.sum(F.log1p("net_return")).alias("x"))
    a, b = (folds.select(F.col("trial").alias(f"{k}_trial"), "fold", F.col("x").alias(k)) for k in ("with", "without"))
    better = pairs.join(a, "with_trial").join(b, ["without_trial", "fold"]).groupBy("with_trial").agg(F.count_if(F.col("with") > F.col("without")).alias("improved_folds"))
    r = va.ablation(metrics, pairs.join(better, "with_trial"))
    digits = {"delta_sharpe": 5, "delta_total_return": 6, "delta_turnover": 5}
    return r.select("with_trial", "without_trial", *[F.round(c, n).alias(c) for c, n in digits.items()], "decision")
