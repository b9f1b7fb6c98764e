"""Walk-forward folds, period accounting, costs, trades and stress scenarios. The fold is a column, not a loop."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS, utc_date
from .aggregates import exact_quantiles
from .joins import asof
from .windows import PART, own, ranked, with_halo


def folds(times: DataFrame, train: int, test: int, embargo: int, width: int = DAY_MS) -> DataFrame:
    """Expanding training stretch, embargo, test stretch, stepped by the test length; an incomplete fold is dropped.

    times: one column t. Its distinct values are numbered once; folds has one row a fold."""
    n = ranked(times.select("t").distinct(), ["t"], "i", width)
    start = train + embargo
    inside = n.where(F.col("i") >= start).withColumn("fold", F.floor((F.col("i") - start) / test).cast("int"))
    f = inside.groupBy("fold").agg(F.min("t").alias("test_start"), F.max("t").alias("test_end"), F.count("*").alias("n"), F.min("i").alias("first")).where(F.col("n") == test)
    ends = n.select(F.col("i").alias("__i"), F.col("t").alias("train_end"))
    begin = n.where("i = 0").select(F.col("t").alias("train_start"))
    out = f.join(ends, F.col("first") - embargo - 1 == F.col("__i")).join(F.broadcast(begin))  # begin is one row
    return out.select("fold", "train_start", "train_end", "test_start", "test_end")


@dataclass(frozen=True)
class Costs:
    """Rates on traded weight. A taker fee holds from a time on; a schedule is a table of fees (see positions)."""

    fee: float = 0.0005
    spread_bps: float = 1.0
    slippage_bps: float = 1.0
    multiplier: float = 1.0

    def rates(self) -> dict[str, float]:
        if self.multiplier < 0:
            raise ValueError("cost multipliers are not negative")
        return {"fee": self.fee * self.multiplier, "spread": self.spread_bps / 20000 * self.multiplier, "slippage": self.slippage_bps / 10000 * self.multiplier}


def positions(w: DataFrame, costs: Costs = Costs(), delay: int = 0, capital: float = 10_000.0, schedule: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Long frame of positions by fold, time and symbol: previous, target and traded weight, price and funding P&L,
    allocated fee, spread and slippage, contributions, participation in the hour's volume, beta contribution.

    w: fold, t, symbol, weight, ret, and, where there are such, funding_rate, volume, beta. Trades are changes of weight,
    from 0 at a fold's start, and positions are closed on its last row. ``delay`` shifts weights by rows. ``schedule``
    has fees by time (from_t, to_t or null, fee), a row a change of fees, in place of the one fee: the latest that began
    at or before a time holds until its to_t, where a null has no end. A time that none covers is an error."""
    s = Window.partitionBy("fold", "symbol").orderBy("t")
    here = lambda c: F.col(c) if c in w.columns else F.lit(0.0)
    rows = w.withColumn("weight", F.lag("weight", delay, 0.0).over(s)) if delay else w
    rows = rows.withColumns({"previous_weight": F.lag("weight", 1, 0.0).over(s), "__last": F.lead("t").over(s).isNull()})
    rate = costs.rates()
    fee = F.lit(rate["fee"])
    if schedule is not None:
        spans = schedule.select(F.col("from_t").alias("__from"), F.col("to_t").alias("__to"), F.col("fee").alias("__fee"))
        rows = asof(rows, spans, {}, "t", "__from", ["__to", "__fee"], "__span", 30 * DAY_MS)
        ended = F.coalesce(F.col("t") >= F.col("__span.__to"), F.lit(False))
        rows = rows.withColumn("__fee", F.when(~ended, F.col("__span.__fee"))).drop("__span")
        fee = F.when(F.col("__fee").isNull(), F.raise_error(F.lit("no fee for this time"))).otherwise(F.col("__fee") * costs.multiplier)
    change = F.col("weight") - F.col("previous_weight")
    rows = rows.withColumn("trade_weight", F.abs(change) + F.when(F.col("__last"), F.abs("weight")).otherwise(0.0))
    rows = rows.withColumns({
        "price_pnl": F.col("weight") * F.col("ret"), "funding_pnl": -F.col("weight") * here("funding_rate"),
        "allocated_fee": F.col("trade_weight") * fee, "allocated_spread": F.col("trade_weight") * rate["spread"], "allocated_slippage": F.col("trade_weight") * rate["slippage"],
        "beta_contribution": F.col("weight") * here("beta"),
        "participation": F.when(here("volume") > 0, capital * F.abs(change) / F.when(here("volume") > 0, here("volume"))).otherwise(0.0),
    })
    gross = F.col("price_pnl") + F.col("funding_pnl")
    cost = F.col("allocated_fee") + F.col("allocated_spread") + F.col("allocated_slippage")
    return rows.withColumns({"gross_contribution": gross, "net_contribution": gross - cost}).drop("__last", "__fee")


def curve(p: DataFrame) -> DataFrame:
    """By fold and time: P&L, costs, net return, turnover, exposures, greatest participation, equity within the fold.
    A net return of -1 or less is an error."""
    g = p.groupBy("fold", "t").agg(
        F.sum("price_pnl").alias("price_pnl"), F.sum("funding_pnl").alias("funding_pnl"), F.sum("allocated_fee").alias("trading_fees"),
        F.sum("allocated_spread").alias("spread_cost"), F.sum("allocated_slippage").alias("slippage_cost"), F.sum("trade_weight").alias("turnover"),
        F.sum(F.abs("weight")).alias("gross_exposure"), F.sum("weight").alias("net_exposure"), F.sum("beta_contribution").alias("beta_exposure"), F.max("participation").alias("participation"),
    )
    net = F.col("price_pnl") + F.col("funding_pnl") - F.col("trading_fees") - F.col("spread_cost") - F.col("slippage_cost")
    g = g.withColumn("net_return", net)
    g = g.withColumn("net_return", F.when(F.col("net_return") > -1, F.col("net_return")).otherwise(F.raise_error(F.lit("equity became non-positive"))))
    w = Window.partitionBy("fold").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("equity", F.exp(F.sum(F.log1p("net_return")).over(w)))


def oos_equity(c: DataFrame) -> DataFrame:
    """Equity compounded across folds: within a fold as it is, times the final equity of all folds before, one row each."""
    ends = c.groupBy("fold").agg(F.sum(F.log1p("net_return")).alias("l"), F.min("t").alias("first"))
    before = ends.select("fold", F.coalesce(F.sum("l").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__l"))
    return c.join(before, "fold").withColumn("oos_equity", F.col("equity") * F.exp("__l")).drop("__l")


def curve_metrics(c: DataFrame, by: list[str], periods_a_year: float = 8760.0) -> DataFrame:
    """The metrics of a curve (with rank_ic where it is known) by group, over its rows in order of time."""
    from .aggregates import return_statistics

    s = return_statistics(c, by, "net_return", "t", periods_a_year)
    ic = [F.avg("rank_ic").alias("mean_rank_ic")] if "rank_ic" in c.columns else []
    net = F.col("price_pnl") + F.col("funding_pnl") - F.col("trading_fees") - F.col("spread_cost") - F.col("slippage_cost")
    g = c.groupBy(*by).agg(
        *[F.sum(x).alias(x) for x in ("price_pnl", "funding_pnl", "trading_fees", "spread_cost", "slippage_cost", "turnover")], F.sum("net_return").alias("net_pnl"),
        (F.sum("turnover") * periods_a_year / F.count("*")).alias("annual_turnover"), F.avg("gross_exposure").alias("mean_gross"), F.avg("net_exposure").alias("mean_net"),
        F.max(F.abs("beta_exposure")).alias("max_beta"), F.max("participation").alias("max_participation"), F.max(F.abs(F.col("net_return") - net)).alias("accounting_error"), *ic,
    )
    if not by:
        return s.join(F.broadcast(g))  # both are one row
    same = reduce(Column.__and__, [F.col(f"l.{x}").eqNullSafe(F.col(f"r.{x}")) for x in by])
    return s.alias("l").join(g.alias("r"), same).select("l.*", *[F.col(f"r.{x}") for x in g.columns if x not in by])


def month(t: Column) -> Column:
    return F.date_format(utc_date(t), "yyyy-MM")


def attribution(p: DataFrame, by: list[str], capital: Column | None = None) -> DataFrame:
    """P&L and costs of positions by group, with each group's share of the summed magnitude of net contributions. Where
    rows are of components, ``capital`` is the share of the capital that a row's component has."""
    part = F.lit(1.0) if capital is None else capital
    g = p.groupBy(*by).agg(*[F.sum(F.col(x) * part).alias(x) for x in ("price_pnl", "funding_pnl", "allocated_fee", "allocated_spread", "allocated_slippage", "net_contribution", "trade_weight")])
    total = g.agg(F.sum(F.abs("net_contribution")).alias("__total"))
    return g.join(F.broadcast(total)).withColumn("share", F.coalesce(F.try_divide(F.abs("net_contribution"), F.col("__total")), F.lit(0.0))).drop("__total")  # total is one row


def position_similarity(a: DataFrame, b: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """Two strategies' weights by time and symbol, period by period and then over the periods in which both are active:
    n, mean and median cosine, mean shares of the smaller gross exposure that both hold (overlap) in the same and in
    opposite directions, the opposite part of the overlap, and the share of periods in which both are active."""
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    j = a.select("t", "symbol", F.col("weight").alias("x")).join(b.select("t", "symbol", F.col("weight").alias("y")), ["t", "symbol"], "full")
    least = F.least(F.abs(x), F.abs(y))
    g = j.groupBy("t").agg(
        F.sum(x * y).alias("xy"), F.sqrt(F.sum(x * x)).alias("nx"), F.sqrt(F.sum(y * y)).alias("ny"), F.least(F.sum(F.abs(x)), F.sum(F.abs(y))).alias("gross"),
        F.sum(F.when(x * y > 0, least).otherwise(0.0)).alias("same"), F.sum(F.when(x * y < 0, least).otherwise(0.0)).alias("opposite"),
    )
    active = (F.col("nx") > epsilon) & (F.col("ny") > epsilon) & (F.col("gross") > epsilon)
    of = lambda c: F.when(active, c / F.when(active, F.col("gross")))
    each = g.select(active.alias("active"), F.when(active, F.col("xy") / F.when(active, F.col("nx") * F.col("ny"))).alias("cosine"), of(F.col("same")).alias("same"), of(F.col("opposite")).alias("opposite"))
    whole = each.agg(F.count_if("active").alias("n"), F.avg("cosine").alias("mean_cosine"), F.avg("same").alias("same_direction"), F.avg("opposite").alias("opposite_direction"), F.avg(F.col("active").cast("double")).alias("both_active"))
    middle = exact_quantiles(each, [], "cosine", {"median_cosine": 0.5})
    out = whole.join(F.broadcast(middle), how="left")  # one row each
    both = F.col("same_direction") + F.col("opposite_direction")
    return out.withColumns({"overlap": both, "conflict": F.when(both > 0, F.col("opposite_direction") / F.when(both > 0, both)).otherwise(0.0)})


def rolling_at_day_ends(c: DataFrame, windows: tuple[int, ...], periods_a_year: float = 8760.0) -> DataFrame:
    """Compounded return, annual volatility and Sharpe ratio (0 without spread) of the last ``window`` rows at each day's
    last row that has as many: t, window, total_return, volatility, sharpe. c: t, net_return, one curve of any length."""
    cut = with_halo(c.select("t", "net_return"), max(windows), 1, by=())
    w = Window.partitionBy(PART).orderBy("t")
    cut = cut.withColumns({"ends": F.coalesce(utc_date(F.lead("t").over(w)) != utc_date(F.col("t")), F.lit(True)), "x": F.log1p("net_return")})

    def one(n: int) -> Column:
        full = w.rowsBetween(-(n - 1), 0)
        r = F.col("net_return")
        sd = F.coalesce(F.stddev_samp(r).over(full), F.lit(0.0))
        sharpe = F.when(sd > 0, F.avg(r).over(full) / F.when(sd > 0, sd) * periods_a_year**0.5).otherwise(0.0)
        return F.struct(F.lit(n).alias("window"), F.count(r).over(full).alias("k"), F.expm1(F.sum("x").over(full)).alias("total_return"), (sd * periods_a_year**0.5).alias("volatility"), sharpe.alias("sharpe"))

    rows = own(cut.withColumn("m", F.array(*map(one, windows)))).where("ends")
    return rows.select("t", F.explode("m").alias("m")).where("m.k = m.window").select("t", "m.window", "m.total_return", "m.volatility", "m.sharpe")


def daily(c: DataFrame) -> DataFrame:
    """By day: compounded net return, equity at the day's end, mean gross exposure."""
    return c.groupBy(utc_date(F.col("t")).alias("day")).agg(F.expm1(F.sum(F.log1p("net_return"))).alias("net_return"), F.avg("gross_exposure").alias("mean_gross"), F.sum("turnover").alias("turnover"))


def daily_positions(p: DataFrame) -> DataFrame:
    """Mean weight and summed trades of each symbol by day."""
    return p.groupBy(utc_date(F.col("t")).alias("day"), "symbol").agg(F.avg("weight").alias("mean_weight"), F.sum("trade_weight").alias("turnover"))


def curve_faults(c: DataFrame, tolerance: float = 1e-12, width: int = 30 * DAY_MS) -> DataFrame:
    """One row: repeated times, folds that begin before the one before ends, values that are not finite, and rows whose
    net return is not P&L less costs within the tolerance. A sound curve has none."""
    from ..functions.columns import finite
    from .windows import previous

    net = F.col("price_pnl") + F.col("funding_pnl") - F.col("trading_fees") - F.col("spread_cost") - F.col("slippage_cost")
    rows = previous(c, [], ["t", "fold"], ["t", "fold"], width)
    bad = [~finite(F.col(x)) for x in ("price_pnl", "funding_pnl", "trading_fees", "spread_cost", "slippage_cost", "net_return", "turnover")]
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.col("t") == F.col("prev.t"), F.lit(False))).alias("repeated_times"), F.count_if(F.coalesce(F.col("fold") < F.col("prev.fold"), F.lit(False))).alias("unordered_folds"),
        F.count_if(reduce(Column.__or__, bad)).alias("not_finite"), F.count_if(F.coalesce(F.abs(F.col("net_return") - net) > tolerance, F.lit(True))).alias("unreconciled"),
    )


def rolling_sharpe(d: DataFrame, days: int = 30) -> DataFrame:
    """Annualised Sharpe of the last ``days`` days at each day's end; null before there are as many or without spread."""
    w = Window.orderBy("day").rowsBetween(-(days - 1), 0)  # a row a day
    sd = F.stddev_samp("net_return").over(w)
    return d.withColumn("sharpe", F.when((F.count("net_return").over(w) == days) & (sd > 1e-15), F.avg("net_return").over(w) / F.when(sd > 1e-15, sd) * 365**0.5))


def stress(w: DataFrame, multipliers: list[float], costs: Costs = Costs(), variants: dict[str, DataFrame] | None = None, full: bool = True, by: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """Total return and turnover by scenario (and by the columns ``by``, such as the trial, within which folds are told
    apart): costs times each multiplier, weights one bar late, and variants of the
    strategy (name to weights). The delayed weights are a second column of the same rows, so the panel is read once;
    the discovery profile (full false) has the costs only."""
    s = Window.partitionBy(*by, "fold", "symbol").orderBy("t")
    rates = sum(costs.rates().values())

    def scenarios(rows: DataFrame, name: str | None) -> DataFrame:
        weights = {"": F.col("weight")} | ({"late": F.lag("weight", 1, 0.0).over(s)} if full and name is None else {})
        rows = rows.withColumns({f"w{k}": c for k, c in weights.items()})
        last = F.lead("t").over(s).isNull()
        rows = rows.withColumns({f"x{k}": F.abs(F.col(f"w{k}") - F.lag(f"w{k}", 1, 0.0).over(s)) + F.when(last, F.abs(f"w{k}")).otherwise(0.0) for k in weights})
        pnl = F.col("ret") - (F.col("funding_rate") if "funding_rate" in rows.columns else F.lit(0.0))
        g = rows.groupBy(*by, "fold", "t").agg(*[F.struct(F.sum(F.col(f"w{k}") * pnl).alias("pnl"), F.sum(f"x{k}").alias("turnover")).alias(f"g{k}") for k in weights])
        each = [(f"cost_x{m:g}" if name is None else name, "g", m) for m in (multipliers if name is None else [1.0])] + ([("delay_1", "glate", 1.0)] if "late" in weights else [])
        one = [F.struct(F.lit(n).alias("scenario"), F.col(f"{k}.turnover").alias("turnover"), (F.col(f"{k}.pnl") - F.col(f"{k}.turnover") * (rates * m)).alias("net")) for n, k, m in each]
        return g.select(*by, F.explode(F.array(*one)).alias("s")).select(*by, "s.*")

    out = scenarios(w, None)
    for name, other in (variants or {}).items() if full else ():
        out = out.union(scenarios(other, name))
    return out.groupBy(*by, "scenario").agg(F.expm1(F.sum(F.log1p("net"))).alias("total_return"), F.sum("turnover").alias("turnover"))


def trade_events(p: DataFrame, epsilon: float = 1e-15) -> DataFrame:
    """Closed trades of positions(): one row a stretch of one sign by fold and symbol, with the reason of its end.

    A trade's costs are those of its own turnover: opening, rebalances, and closing, which at a flip is on the next
    trade's first row and at a fold's end on its own last. P&L is of the rows it is open."""
    s = Window.partitionBy("fold", "symbol").orderBy("t")
    side = F.when(F.abs("weight") > epsilon, F.signum("weight")).otherwise(0.0)
    before = F.when(F.abs("previous_weight") > epsilon, F.signum("previous_weight")).otherwise(0.0)
    cost = F.col("allocated_fee") + F.col("allocated_spread") + F.col("allocated_slippage")
    rate = F.when(F.col("trade_weight") > epsilon, cost / F.when(F.col("trade_weight") > epsilon, F.col("trade_weight"))).otherwise(0.0)
    rows = p.withColumns({"side": side, "before": before, "rate": rate, "next_t": F.lead("t").over(s)})
    rows = rows.withColumns({"next_side": F.lead("side").over(s), "next_rate": F.lead("rate").over(s), "new": ((F.col("side") != F.col("before")) & (F.col("side") != 0)).cast("int")})
    rows = rows.withColumn("trade", F.sum("new").over(s)).where("side <> 0")
    last = F.col("next_t").isNull() | (F.col("next_side") != F.col("side"))
    opened = F.when(F.col("new") == 1, F.abs("weight")).otherwise(F.abs(F.col("weight") - F.col("previous_weight")))
    closed = F.when(last, F.abs("weight")).otherwise(0.0)
    close_rate = F.when(F.col("next_t").isNull(), F.col("rate")).otherwise(F.col("next_rate"))
    reason = F.when(F.col("next_t").isNull(), "fold_close").when(F.col("next_side") == 0, "signal_exit").otherwise("direction_flip")
    end = F.coalesce("next_t", F.col("label_end_t") if "label_end_t" in p.columns else F.col("t"))
    g = rows.groupBy("fold", "symbol", "trade").agg(
        F.max("side").alias("side"), F.min("t").alias("entry"), F.max_by(end, "t").alias("exit"), F.max_by(reason, "t").alias("exit_reason"), F.min_by("weight", "t").alias("entry_weight"), F.max(F.abs("weight")).alias("maximum_weight"),
        F.sum("price_pnl").alias("price_return"), F.sum("funding_pnl").alias("funding_return"), F.sum(opened * F.col("rate") + F.coalesce(closed * close_rate, F.lit(0.0))).alias("explicit_cost"), F.sum(opened + closed).alias("turnover"), F.count("*").alias("n_rows"),
    )
    return g.withColumn("net_return", F.col("price_return") + F.col("funding_return") - F.col("explicit_cost"))


def pair_diagnostics(p: DataFrame, pairs: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """P&L and own turnover of each pair by fold. p: positions(); pairs: fold, t, symbol, other, pair_weight (dense).
    With models (strategies.pair_models) each row has its pair's beta, half-life and eligibility, and a pair that never
    traded in a fold has a row of zeros."""
    cost = F.col("allocated_fee") + F.col("allocated_spread") + F.col("allocated_slippage")
    rate = F.when(F.col("trade_weight") > 1e-15, cost / F.when(F.col("trade_weight") > 1e-15, F.col("trade_weight"))).otherwise(0.0)
    s = Window.partitionBy("fold", "other", "symbol").orderBy("t")
    funding = F.col("funding_rate") if "funding_rate" in p.columns else F.lit(0.0)
    rows = pairs.join(p.select("fold", "t", "symbol", "ret", funding.alias("funding_rate"), rate.alias("rate")), ["fold", "t", "symbol"])
    moved = F.abs(F.col("pair_weight") - F.lag("pair_weight", 1, 0.0).over(s)) + F.when(F.lead("t").over(s).isNull(), F.abs("pair_weight")).otherwise(0.0)
    g = rows.withColumn("moved", moved).groupBy("other", "fold").agg(F.sum(F.col("pair_weight") * F.col("ret")).alias("price_pnl"), F.sum(-F.col("pair_weight") * F.col("funding_rate")).alias("funding_pnl"), F.sum(F.col("moved") * F.col("rate")).alias("explicit_cost"), F.sum("moved").alias("turnover"))
    if models is not None:
        g = models.select("other", "fold", "beta", "half_life", "eligible").join(g, ["other", "fold"], "left").na.fill(0.0, ["price_pnl", "funding_pnl", "explicit_cost", "turnover"])
    return g.withColumn("net_pnl", F.col("price_pnl") + F.col("funding_pnl") - F.col("explicit_cost"))


def netted(parts: DataFrame, costs: Costs = Costs()) -> DataFrame:  # noqa: B008
    """Sleeves held apart against one netted portfolio, by fold and time. parts: sleeve, share, fold, t, symbol, weight,
    ret, and funding_rate where positions pay it: it is the same for both, as are prices. The netted portfolio trades summed weights; offset is the turnover that sleeves would trade against each
    other, and savings its cost."""
    rates = sum(costs.rates().values())
    scaled = parts.withColumn("weight", F.col("share") * F.col("weight"))
    paid = F.col("funding_rate") if "funding_rate" in parts.columns else F.lit(0.0)

    def moved(rows: DataFrame, keys: list[str]) -> DataFrame:
        s = Window.partitionBy("fold", *keys).orderBy("t")
        trade = F.abs(F.col("weight") - F.lag("weight", 1, 0.0).over(s)) + F.when(F.lead("t").over(s).isNull(), F.abs("weight")).otherwise(0.0)
        return rows.withColumn("trade", trade)

    apart = moved(scaled, ["sleeve", "symbol"]).groupBy("fold", "t").agg(F.sum("trade").alias("sleeve_turnover"), F.sum(F.col("weight") * F.col("ret")).alias("price_pnl"), F.sum(-F.col("weight") * paid).alias("funding_pnl"))
    one = scaled.groupBy("fold", "t", "symbol").agg(F.sum("weight").alias("weight"))
    one = moved(one, ["symbol"]).groupBy("fold", "t").agg(F.sum("trade").alias("netted_turnover"), F.sum(F.abs("weight")).alias("netted_gross"))
    out = apart.join(one, ["fold", "t"])
    saved, gross = F.col("sleeve_turnover") - F.col("netted_turnover"), F.col("price_pnl") + F.col("funding_pnl")
    return out.withColumns({"offset": saved, "offset_ratio": F.coalesce(F.try_divide(saved, F.col("sleeve_turnover")), F.lit(0.0)), "savings": saved * rates, "sleeve_net": gross - F.col("sleeve_turnover") * rates, "netted_net": gross - F.col("netted_turnover") * rates})


def trade_episodes(w: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """One row for each stretch of one sign by fold and symbol: entry, exit, rows, P&L, peak weight."""
    s = Window.partitionBy("fold", "symbol").orderBy("t")
    side = F.when(F.abs("weight") > epsilon, F.signum("weight")).otherwise(0.0)
    rows = w.withColumn("side", side).withColumn("__new", (F.col("side") != F.lag("side", 1, 0.0).over(s)).cast("int")).withColumn("episode", F.sum("__new").over(s))
    return rows.where("side <> 0").groupBy("fold", "symbol", "episode", "side").agg(F.min("t").alias("entry"), F.max("t").alias("exit"), F.count("*").alias("n_rows"), F.sum(F.col("weight") * F.col("ret")).alias("pnl"), F.max(F.abs("weight")).alias("peak_weight"))


def trade_legs(w: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """Every change of weight named entry, exit, flip, increase or reduce, with a forced close at each fold's end, its
    size, and whether it buys."""
    s = Window.partitionBy("fold", "symbol").orderBy("t")
    p, c = F.col("previous"), F.col("weight")
    kind = F.when(F.abs(p) <= epsilon, "entry").when(F.abs(c) <= epsilon, "exit").when(p * c < 0, "flip").when(F.abs(c) > F.abs(p), "increase").otherwise("reduce")
    rows = w.withColumn("previous", F.lag("weight", 1, 0.0).over(s))
    legs = rows.where(F.abs(c - p) > epsilon).select("fold", "symbol", "t", kind.alias("kind"), F.abs(c - p).alias("size"), (c > p).alias("bought"))
    close = w.withColumn("__last", F.lead("t").over(s).isNull()).where(F.col("__last") & (F.abs(c) > epsilon)).select("fold", "symbol", "t", F.lit("fold_close").alias("kind"), F.abs(c).alias("size"), (c < 0).alias("bought"))
    return legs.union(close)


def rank_ic(df: DataFrame, score: str, outcome: str) -> DataFrame:
    """Correlation of the two cross-sectional ranks at each time."""
    from .windows import cs_rank

    r = df.withColumn("__a", cs_rank(F.col(score))).withColumn("__b", cs_rank(F.col(outcome)))
    return r.groupBy("t").agg(F.count("*").alias("n"), F.corr("__a", "__b").alias("rank_ic"))
