"""What closed trades and the legs of rebalancing say of a strategy, by any number of grains in one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import HOUR_MS, utc_date
from ..sources.files import staged
from .aggregates import exact_quantiles

TINY = 1e-15


def trade_grains(reason: Column | None = None) -> dict[str, Column]:
    """The grains of trade_metrics: symbol, side, month and hour (UTC) of the entry, and the reason of the entry."""
    return {
        "symbol": F.col("symbol"),
        "side": F.when(F.col("side") > 0, "LONG").otherwise("SHORT"),
        "month": F.date_format(utc_date(F.col("entry")), "yyyy-MM"),
        "hour_utc": F.pmod(F.floor(F.col("entry") / HOUR_MS), F.lit(24)).cast("string"),
        "entry_reason": F.lit("signal") if reason is None else reason,
    }


def trade_metrics(events: DataFrame, grains: dict[str, Column] | None = None) -> DataFrame:
    """scope, group and the figures of closed trades (backtest.trade_events): all together (overall, all) and by each
    grain, a null of which is the group ''. Flips are counted overall only. Without trades there is the overall row, of zeros.

    A trade is repeated once a grain and summed up before the shuffle; the quantiles of the hours held and of net returns
    are exact, from cells of values (aggregates.exact_quantiles), so a group may hold all trades."""
    grains = trade_grains() if grains is None else grains
    one = lambda scope, group: F.struct(F.lit(scope).alias("scope"), F.coalesce(group.cast("string"), F.lit("")).alias("group"))
    scopes = F.array(one("overall", F.lit("all")), *[one(k, c) for k, c in grains.items()])
    t = staged(events.select(
        scopes.alias("s"), ((F.col("exit") - F.col("entry")) / HOUR_MS).alias("hours"), "net_return", "price_return", "funding_return", "explicit_cost", "turnover",
        (F.col("exit_reason") == "direction_flip").cast("long").alias("flip"),
    ))
    t = t.select(F.explode("s").alias("s"), *t.columns[1:]).select("s.*", *t.columns[1:])
    net, by = F.col("net_return"), ["scope", "group"]
    gains, losses = F.sum(F.greatest(net, F.lit(0.0))), F.sum(F.greatest(-net, F.lit(0.0)))
    g = staged(t.groupBy(*by).agg(
        F.count("*").alias("completed_trades"), F.sum(F.when(F.col("scope") == "overall", F.col("flip")).otherwise(0)).alias("direction_flips"),
        F.avg("hours").alias("holding_hours_mean"), F.avg((net > 0).cast("double")).alias("win_rate"), F.avg(net).alias("payoff_mean"), (gains / F.greatest(losses, F.lit(TINY))).alias("profit_factor"),
        F.sum("price_return").alias("price_pnl"), F.sum("funding_return").alias("funding_pnl"), F.sum(F.col("price_return") + F.col("funding_return")).alias("gross_pnl"),
        F.sum("explicit_cost").alias("explicit_cost"), F.sum(net).alias("net_pnl"), F.sum("turnover").alias("turnover"),
        F.min("hours").alias("__h0"), F.max("hours").alias("__h1"), F.count("hours").alias("__hn"), F.min(net).alias("__p0"), F.max(net).alias("__p1"), F.count(net).alias("__pn"),
    ))
    ends = lambda k: g.where(F.col(f"__{k}n") > 0).select(*by, F.col(f"__{k}0").alias("__low"), F.col(f"__{k}1").alias("__high"), F.col(f"__{k}n").alias("__n"))
    held = exact_quantiles(t, by, "hours", {"holding_hours_median": 0.5, "holding_hours_p10": 0.1, "holding_hours_p90": 0.9}, ends=ends("h"))
    paid = exact_quantiles(t, by, "net_return", {"payoff_median": 0.5}, ends=ends("p"))
    always = events.sparkSession.range(1).select(F.lit("overall").alias("scope"), F.lit("all").alias("group"))
    out = g.join(held, by, "left").join(paid, by, "left").join(always, by, "full")
    bps = lambda c: 1e4 * F.col(c) / F.greatest(F.col("turnover"), F.lit(TINY))
    out = out.na.fill(0).withColumns({f"{k}_bps_per_turnover": bps(c) for k, c in (("gross_edge", "gross_pnl"), ("net_edge", "net_pnl"), ("explicit_cost", "explicit_cost"))})
    out = out.withColumns({"entries": F.col("completed_trades"), "exits": F.col("completed_trades")})
    return out.drop("__h0", "__h1", "__hn", "__p0", "__p1", "__pn")


#: Kinds of legs (backtest.trade_legs) and the names of their counts.
LEG_COUNTS = {"entry": "entries", "exit": "exits", "increase": "increases", "reduce": "reductions", "flip": "flips", "fold_close": "forced_fold_closes"}


def leg_statistics(legs: DataFrame, periods: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a group of ``by`` (or in all): times with trades, legs by kind, traded weight in all, bought and sold, its
    mean, median, p90 and maximum, mean hours between times with trades, and the share of periods without.

    legs: by, t, kind, size, bought; periods: by, t, of which repeated times count once. Groups of ``periods`` without legs have zeros,
    groups of legs that it lacks are left out. Gaps between the times of trades need no order: their sum is the last time less the first."""
    by = list(by)
    rows = staged(legs.select(*by, "t", "kind", F.col("size").cast("double").alias("size"), "bought"))
    of = lambda c: F.sum(F.when(c, F.col("size")).otherwise(0.0))
    times = rows.select(*by, "t").distinct()
    span = times.groupBy(*by).agg(F.count("*").alias("rebalance_events"), ((F.max("t") - F.min("t")) / HOUR_MS).alias("__hours"))
    g = rows.groupBy(*by).agg(
        F.count("*").alias("trade_legs"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in LEG_COUNTS.items()], F.sum("size").alias("traded_weight"), F.avg("size").alias("mean_weight"),
        F.max("size").alias("maximum_weight"), of(F.col("bought")).alias("long_weight"), of(~F.col("bought")).alias("short_weight"),
    )
    q = exact_quantiles(rows, by, "size", {"median_weight": 0.5, "p90_weight": 0.9})
    n = periods.select(*by, "t").distinct().groupBy(*by).agg(F.count("*").alias("periods"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        if not by:
            return left.join(F.broadcast(right), how="left")  # one row at most
        same = reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by])
        return left.alias("l").join(right.alias("r"), same, "left").select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in by])

    out = reduce(beside, (span, g, q), n)
    gap = F.when(F.col("rebalance_events") > 1, F.col("__hours") / (F.col("rebalance_events") - 1))
    out = out.withColumn("mean_hours_between", gap)
    out = out.na.fill(0, [c for c in out.columns if c not in by])
    idle = F.when(F.col("periods") > 0, F.greatest(F.lit(0.0), 1 - F.col("rebalance_events") / F.col("periods"))).otherwise(0.0)
    return out.withColumn("idle_fraction", idle).drop("__hours")
