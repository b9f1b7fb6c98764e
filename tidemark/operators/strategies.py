"""Scores of symbols at each time from features. Each function takes decision rows (symbol, t and feature columns) and
adds ``score``; composite strategies add their sleeves' scores, too.

Rows that a trailing window cannot fill have the last value that it could, across gaps in time, or null before the
first. Strategies that are fitted take rows with a fold column on both sides (see joins.with_folds): train rows of a
fold, and test rows of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import HOUR_MS, TINY, clip
from ..sources.files import staged
from . import windows as wn
from .aggregates import exact_quantiles
from .portfolio import sparse_state


def _mix(parts: dict[str, float]) -> Column:
    """Weighted sum of cross-sectional z-scores."""
    return reduce(Column.__add__, [F.lit(k) * wn.cs_zscore(F.col(c)) for c, k in parts.items()])


def residual_momentum(df: DataFrame, w1: float = 0.2, w4: float = 0.3, w24: float = 0.5) -> DataFrame:
    return df.withColumn("score", _mix({"residual_momentum_1h": w1, "residual_momentum_4h": w4, "residual_momentum_24h": w24}))


def residual_mean_reversion(df: DataFrame, w1: float = 0.5, w4: float = 0.5, adjustment: float = 1.0) -> DataFrame:
    score = -_mix({"residual_momentum_1h": w1, "residual_momentum_4h": w4})
    if adjustment:
        vol = F.col("realized_volatility_24h")
        median = F.percentile(vol, 0.5).over(wn.by_time())  # of the symbols of one time
        relative = F.when(median > TINY, vol / F.when(median > TINY, median)).otherwise(1.0)
        score = score / F.pow(F.greatest(relative, F.lit(1e-12)), F.lit(float(adjustment)))
    return df.withColumn("score", score)


def funding_carry(df: DataFrame, rate: float = 0.6, change: float = 0.2, momentum: float = 0.2, name: str = "score") -> DataFrame:
    return df.withColumn(name, _mix({"funding_rate_current": -rate, "funding_rate_change": -change, "residual_momentum_4h": momentum}))


def trailing_return(df: DataFrame, n: int, name: str, step_ms: int = HOUR_MS) -> DataFrame:
    return wn.segmented_sum(df, "log_return_1h", n, name, step_ms, number=False)


def sma_ratio(df: DataFrame, fast: int, slow: int, name: str = "score", step_ms: int = HOUR_MS) -> DataFrame:
    """Log ratio of the moving averages of a price compounded from returns within unbroken stretches of time."""
    cut = wn.segments(wn.with_halo(staged(df), slow), step_ms)
    inner = Window.partitionBy("symbol", wn.PART, "seg").orderBy("t")
    # The ratio is the same wherever in a stretch the price begins, so a part's price begins in its halo.
    cut = cut.withColumn("__p", F.exp(F.sum("log_return_1h").over(inner) - F.first("log_return_1h").over(inner)))
    ratio = F.ln(wn.rolling_mean(F.col("__p"), fast, inner) / wn.rolling_mean(F.col("__p"), slow, inner))
    cut = cut.withColumn("__r", F.when(F.row_number().over(inner) >= slow, ratio))
    return wn.carried(wn.own(cut), "__r", name, ["symbol"]).drop("__p", "__r", "seg")


def sma_crossover(df: DataFrame, fast: int = 24, slow: int = 168, name: str = "score", step_ms: int = HOUR_MS) -> DataFrame:
    return sma_ratio(df, fast, slow, "__sma", step_ms).withColumn(name, wn.cs_zscore(F.col("__sma"))).drop("__sma")


def sma_trend_strength(df: DataFrame, fast: int = 24, slow: int = 168, step_ms: int = HOUR_MS) -> DataFrame:
    return sma_ratio(df, fast, slow, "score", step_ms)


def volatility_filtered_sma(train: DataFrame, test: DataFrame, quantile: float = 0.8) -> DataFrame:
    """Zero where the market's volatility is above its quantile over the fold's training times. test has the SMA ratio
    as score (sma_ratio over all rows, before the test rows are taken)."""
    times = train.groupBy("fold", "t").agg(F.max("market_volatility_regime").alias("m"))
    limit = exact_quantiles(times, ["fold"], "m", {"__limit": quantile})
    out = test.join(limit, "fold", "left")
    return out.withColumn("score", F.when(F.col("market_volatility_regime") > F.col("__limit"), 0.0).otherwise(F.col("score"))).drop("__limit")


def relative_strength(df: DataFrame, lookback: int = 168, name: str = "score", step_ms: int = HOUR_MS) -> DataFrame:
    return trailing_return(df, lookback, "__rs", step_ms).withColumn(name, wn.cs_zscore(F.col("__rs"))).drop("__rs")


def multi_horizon_trend(df: DataFrame, lookbacks: tuple[int, ...] = (24, 72, 168), weights: tuple[float, ...] = (0.2, 0.3, 0.5), step_ms: int = HOUR_MS) -> DataFrame:
    for n in lookbacks:
        df = trailing_return(df, n, f"__tr{n}", step_ms)
    score = reduce(Column.__add__, [F.lit(k) * F.signum(f"__tr{n}") for n, k in zip(lookbacks, weights, strict=True)])
    return df.withColumn("score", score).drop(*[f"__tr{n}" for n in lookbacks])


def market_regime_trend(df: DataFrame, fast: int = 24, slow: int = 168, name: str = "score", step_ms: int = HOUR_MS) -> DataFrame:
    """1 where the market and the symbol rise over the slow lookback and the symbol over the fast one, else 0."""
    df = trailing_return(trailing_return(df, fast, "__fast", step_ms), slow, "__slow", step_ms)
    up = (F.avg("__slow").over(wn.by_time()) > 0) & (F.col("__fast") > 0) & (F.col("__slow") > 0)
    return df.withColumn(name, F.when(F.col("__fast").isNotNull() & F.col("__slow").isNotNull(), up.cast("double"))).drop("__fast", "__slow")


def donchian_breakout(df: DataFrame, entry: int = 72, exit_: int = 24, step_ms: int = HOUR_MS) -> DataFrame:
    """+1 from a close above the highest of the ``entry`` rows before it, -1 from one below the lowest, until the close
    crosses the ``exit_`` rows' other extreme; flat at the start of each unbroken stretch.

    An entry stands whatever came before it, so the state is a window: the last entry's side, unless its exit came
    since. No row needs the row before it to be done."""
    df = wn.segments(df, step_ms)
    inner = Window.partitionBy("symbol", "seg").orderBy("t")
    p = F.exp(F.sum("log_return_1h").over(inner) - F.first("log_return_1h").over(inner))
    df = df.withColumn("__p", p)
    high, low = wn.prior_extrema(F.col("__p"), F.col("__p"), entry, inner)
    out_high, out_low = wn.prior_extrema(F.col("__p"), F.col("__p"), exit_, inner)
    ready = F.row_number().over(inner) > entry
    side = F.when(ready & (F.col("__p") > high), 1.0).when(ready & (F.col("__p") < low), -1.0)
    df = df.withColumns({"__in": side, "__down": F.col("__p") < out_low, "__up": F.col("__p") > out_high})
    df = df.withColumn("__k", F.count("__in").over(inner)).withColumn("__side", F.last("__in", ignorenulls=True).over(inner))
    since = Window.partitionBy("symbol", "seg", "__k").orderBy("t")
    left = F.when(F.col("__in").isNotNull(), False).when(F.col("__side") > 0, F.col("__down")).otherwise(F.col("__up"))
    gone = F.max(F.coalesce(left, F.lit(False)).cast("int")).over(since)
    return df.withColumn("score", F.when((F.col("__k") > 0) & (gone == 0), F.col("__side")).otherwise(0.0)).drop("__p", "__in", "__down", "__up", "__k", "__side", "seg")


def carry_relative_strength(df: DataFrame, lookback: int = 168, step_ms: int = HOUR_MS, **carry: float) -> DataFrame:
    df = relative_strength(funding_carry(df, name="carry_score", **carry), lookback, "relative_strength_score", step_ms)
    return df.withColumn("score", (F.col("carry_score") + F.col("relative_strength_score")) / 2)


def carry_dual_trend(df: DataFrame, lookback: int = 168, fast: int = 24, slow: int = 168, step_ms: int = HOUR_MS, **carry: float) -> DataFrame:
    df = sma_crossover(carry_relative_strength(df, lookback, step_ms, **carry), fast, slow, "sma_score", step_ms)
    return df.withColumn("score", (F.col("carry_score") + F.col("relative_strength_score") + F.col("sma_score")) / 3)


def carry_multi_horizon(df: DataFrame, fast: int = 72, slow: int = 336, step_ms: int = HOUR_MS, **carry: float) -> DataFrame:
    df = funding_carry(df, name="carry_score", **carry)
    df = relative_strength(relative_strength(df, fast, "fast_strength_score", step_ms), slow, "slow_strength_score", step_ms)
    return df.withColumn("score", (F.col("carry_score") + F.col("fast_strength_score") + F.col("slow_strength_score")) / 3)


def carry_multi_regime(df: DataFrame, fast: int = 72, slow: int = 336, regime_fast: int = 24, regime_slow: int = 168, step_ms: int = HOUR_MS, **carry: float) -> DataFrame:
    return market_regime_trend(carry_multi_horizon(df, fast, slow, step_ms, **carry), regime_fast, regime_slow, "regime_trend_score", step_ms)


def carry_consensus_strength(df: DataFrame, fast: int = 72, slow: int = 336, step_ms: int = HOUR_MS, **carry: float) -> DataFrame:
    df = carry_multi_horizon(df, fast, slow, step_ms, **carry)
    a, b = F.col("fast_strength_score"), F.col("slow_strength_score")
    df = df.withColumn("relative_strength_score", F.when(F.signum(a) == F.signum(b), (a + b) / 2).otherwise(0.0))
    return df.withColumn("score", (F.col("carry_score") + F.col("relative_strength_score")) / 2)


RIDGE = ("residual_momentum_1h", "residual_momentum_4h", "residual_momentum_24h", "funding_rate_current", "quote_volume_zscore_24h", "taker_buy_imbalance_1h")


def linear_cross_sectional(train: DataFrame, test: DataFrame, alpha: float = 1.0, features: tuple[str, ...] = RIDGE, target: str = "future_residual_return_1h") -> DataFrame:
    """Ridge regression of the demeaned, scaled and clipped outcome on cross-sectional z-scores, by fold.

    The normal equations are averages over the training rows; a fold's are one row, solved where that row is."""
    w = Window.partitionBy("fold", "t")
    z = {f"__x{i}": wn.cs_zscore(F.col(f), w) for i, f in enumerate(features)}
    xs = list(z)
    rows = train.withColumns(z | {"__c": F.col(target) - F.avg(target).over(w)})
    scale = rows.groupBy("fold").agg(F.stddev_pop("__c").alias("__s"))
    rows = rows.join(scale, "fold").withColumn("__y", clip(F.col("__c") / F.when(F.col("__s") > TINY, F.col("__s")), -5.0, 5.0))
    gram = [F.avg(F.col(a) * F.col(b)) for a in xs for b in [*xs, "__y"]]
    sums = rows.groupBy("fold").agg(F.array(*gram).alias("g"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g in b["g"]:
                m = np.asarray(g, float).reshape(len(xs), len(xs) + 1)
                out.append(np.linalg.solve(m[:, :-1] + alpha * np.eye(len(xs)), m[:, -1]).tolist())
            yield pd.DataFrame({"fold": b["fold"], "coefficients": out})

    fitted = sums.where(~F.exists("g", lambda x: x.isNull())).mapInPandas(solve, f"fold {train.schema['fold'].dataType.simpleString()}, coefficients array<double>")
    rows = test.join(fitted, "fold", "left").withColumns(z)
    rows = rows.withColumn("__raw", reduce(Column.__add__, [F.get("coefficients", F.lit(i)) * F.col(x) for i, x in enumerate(xs)]))
    return rows.withColumn("score", wn.cs_zscore(F.col("__raw"), w)).drop("__raw", *xs)


def quarter_hour_flow(df: DataFrame, aggregation: int = 4) -> DataFrame:
    """Adds entry: the trailing mean of the quarters' excess flow where it is 1 or more, clipped at 3."""
    cut = wn.with_halo(df, aggregation)
    m = wn.trailing_sum(F.col("quarter_flow_excess_z_168h"), aggregation, 0, wn.by_symbol(cut)) / aggregation
    return wn.own(cut.withColumn("__m", m)).withColumn("entry", F.when(F.abs("__m") >= 1, clip(F.col("__m"), -3.0, 3.0)).otherwise(0.0)).drop("__m")


def flow_absorption(df: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Adds entry: against a strong flow that the price did not follow."""
    z = F.col("signed_taker_flow_z_168h")
    trigger = (F.abs(z) >= threshold) & (F.col("quote_volume_zscore_24h") >= 0) & (F.col("flow_price_agreement_1h") <= 0.25)
    return df.withColumn("entry", F.when(trigger, -clip(z, -3.0, 3.0)).otherwise(0.0))


def compression_breakout(train: DataFrame, test: DataFrame, quantile: float = 0.2) -> DataFrame:
    """Adds entry: a close beyond the prior range after a row of compressed volatility, by the fold's and symbol's
    training quantile. test has prior_compression, the compression of the symbol's row before (over all rows)."""
    limit = exact_quantiles(train, ["fold", "symbol"], "volatility_compression_4h_168h", {"__limit": quantile})
    rows = test.join(limit, ["fold", "symbol"], "left")
    ok = (F.col("prior_compression") <= F.col("__limit")) & (F.col("quote_volume_zscore_24h") >= 0) & (F.col("efficiency_ratio_24h") >= 0.25)
    close = F.exp("log_close_level")
    return rows.withColumn("entry", F.when(ok & (close > F.col("prior_high_72h")), 1.0).when(ok & (close < F.col("prior_low_72h")), -1.0).otherwise(0.0)).drop("__limit")


def held(df: DataFrame, hours: int, leave: str | None = None) -> DataFrame:
    """score from sparse entries, by fold and symbol (see portfolio.sparse_state)."""
    return sparse_state(df, ["fold", "symbol"], "entry", hours, leave).withColumnRenamed("position", "score").drop("entry")


def pair_models(train: DataFrame, base: str, others: list[str], fit_rows: int = 720, z_rows: int = 168, betas: tuple[float, float] = (0.2, 3.0), half_lives: tuple[float, float] = (2.0, 168.0)) -> DataFrame:
    """Per fold and pair, over the last ``fit_rows`` common training rows: regression of the other's log price on the
    base's, the residual's mean and deviation over its last ``z_rows``, half-life of its autoregression. A pair is
    eligible if all rows are there and its beta and half-life lie between the given limits."""
    x = train.where(F.col("symbol") == base).select("fold", "t", F.col("log_close_level").alias("x"))
    y = train.where(F.col("symbol").isin(others)).select("fold", "t", F.col("symbol").alias("other"), F.col("log_close_level").alias("y"))
    by = Window.partitionBy("fold", "other")
    rows = y.join(x, ["fold", "t"]).withColumn("back", F.row_number().over(by.orderBy(F.desc("t")))).where(F.col("back") <= fit_rows)
    n, vx = F.count(F.col("x") + F.col("y")).over(by), F.var_pop("x").over(by)
    rows = rows.withColumns({"n": n, "beta": F.when(vx > TINY, F.covar_pop("x", "y").over(by) / F.when(vx > TINY, vx)), "mx": F.avg("x").over(by), "my": F.avg("y").over(by)})
    rows = rows.withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx")).withColumn("e", F.col("y") - F.col("alpha") - F.col("beta") * F.col("x"))
    rows = rows.withColumn("c", F.col("e") - F.avg("e").over(by)).withColumn("c_next", F.lead("c").over(by.orderBy("t")))
    late = F.when(F.col("back") <= z_rows, F.col("e"))
    g = rows.groupBy("fold", "other").agg(
        F.max("n").alias("n"), F.max("alpha").alias("alpha"), F.max("beta").alias("beta"), F.avg(late).alias("mean"), F.stddev_pop(late).alias("std"),
        F.sum(F.when(F.col("c_next").isNotNull(), F.col("c") * F.col("c_next"))).alias("__num"), F.sum(F.when(F.col("c_next").isNotNull(), F.col("c") * F.col("c"))).alias("__den"),
    )
    phi = F.when(F.col("__den") > TINY, F.col("__num") / F.when(F.col("__den") > TINY, F.col("__den")))
    g = g.withColumn("half_life", F.when((phi > 0) & (phi < 1), -F.lit(float(np.log(2))) / F.ln(phi)).otherwise(float("inf")))
    ok = (F.col("n") == fit_rows) & F.col("beta").between(*betas) & F.col("half_life").between(*half_lives) & (F.col("std") > TINY)
    return g.select("fold", "other", "alpha", "beta", "mean", "std", "half_life", F.coalesce(ok, F.lit(False)).alias("eligible"))


def pair_spread_reversion(models: DataFrame, test: DataFrame, base: str, entry_z: float = 2.0, max_hold: int = 96) -> DataFrame:
    """Per fold, time and pair: the spread's z, and the held side of the other symbol; the hedge is -beta on the base."""
    level = F.col("log_close_level")
    x = test.where(F.col("symbol") == base).select("fold", "t", level.alias("x"))
    rows = test.where(F.col("symbol") != base).select("fold", "t", F.col("symbol").alias("other"), level.alias("y")).join(x, ["fold", "t"]).join(models.where("eligible"), ["fold", "other"])
    rows = rows.withColumn("z", (F.col("y") - F.col("alpha") - F.col("beta") * F.col("x") - F.col("mean")) / F.col("std"))
    rows = rows.withColumns({"entry": F.when(F.abs("z") >= entry_z, -F.signum("z")).otherwise(0.0), "leave": F.abs("z") <= 0.5})
    out = sparse_state(rows, ["fold", "other"], "entry", max_hold, "leave")
    return out.select("fold", "t", "other", "z", "beta", F.col("position").alias("side"))


def pair_legs(pairs: DataFrame, base: str) -> DataFrame:
    """Pair sides as scores of symbols: fold, t, other (the pair), symbol, raw."""
    leg = F.explode(F.array(F.struct(F.col("other").alias("symbol"), F.col("side").alias("raw")), F.struct(F.lit(base).alias("symbol"), (-F.col("beta") * F.col("side")).alias("raw"))))
    return pairs.select("fold", "t", "other", leg.alias("l")).select("fold", "t", "other", "l.*")
