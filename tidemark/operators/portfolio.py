"""Scores to target weights. Policies keep their state within a group (a fold), whose length is bounded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import HOUR_MS, TINY
from .windows import by_time

DAYS_A_YEAR = 365.0


@dataclass(frozen=True)
class Limits:
    """Greatest gross exposure, annual volatility aimed at, and greatest weight of a symbol."""

    gross: float = 0.5
    volatility_target: float = 0.15
    symbol_cap: float = 0.25

    def __post_init__(self) -> None:
        if not all(0 < x <= 1 for x in (self.gross, self.volatility_target, self.symbol_cap)):
            raise ValueError("limits are in (0, 1]")


def _scaled(df: DataFrame, raw: str, vol: str, limits: Limits, by, name: str = "weight") -> DataFrame:
    """Weights in proportion to raw: gross by the limits and the volatility aimed at, then all shrunk so that none
    passes the cap. vol is a day's volatility; raw of 0 gives 0."""
    total = F.sum(F.abs(F.col(raw))).over(by)
    df = df.withColumn("__u", F.when(total > TINY, F.col(raw) / F.when(total > TINY, total)).otherwise(0.0))
    risk = F.sqrt(F.sum(F.pow(F.col("__u") * F.col(vol) * DAYS_A_YEAR**0.5, F.lit(2.0))).over(by))
    df = df.withColumn("__u", F.col("__u") * F.when(risk > 0, F.least(F.lit(limits.gross), limits.volatility_target / F.when(risk > 0, risk))).otherwise(limits.gross))
    most = F.max(F.abs("__u")).over(by)
    return df.withColumn(name, F.col("__u") * F.when(most > limits.symbol_cap, limits.symbol_cap / F.when(most > 0, most)).otherwise(1.0)).drop("__u")


def neutral(df: DataFrame, raw: str, beta: str, vol: str, limits: Limits, by) -> DataFrame:
    """Weights of a pair (raw: 1 for its long, -1 for its short symbol, else 0) made neutral to the market and to beta.

    The projection of raw onto the space orthogonal to ones and betas has a closed form in sums; where the long leg's
    would not be positive or the short leg's not negative, the raw pair stands."""
    b, x = F.col(beta), F.col(raw)
    n, sb, sbb, d = F.count(F.lit(1)).over(by), F.sum(b).over(by), F.sum(b * b).over(by), F.sum(x * b).over(by)
    df = df.withColumns({"__n": n, "__sb": sb, "__det": n * sbb - sb * sb, "__d": d})
    fit = x - F.coalesce(F.when(F.col("__det") > 1e-12, (F.col("__n") * b - F.col("__sb")) * F.col("__d") / F.when(F.col("__det") > 1e-12, F.col("__det"))), F.lit(0.0))
    df = df.withColumn("__fit", fit)
    good = F.min(F.when(x != 0, x * F.col("__fit"))).over(by) > 0
    df = df.withColumn("__w", F.when(good & (F.sum(F.abs("__fit")).over(by) > 1e-12), F.col("__fit")).otherwise(x))
    return _scaled(df, "__w", vol, limits, by).drop("__n", "__sb", "__det", "__d", "__fit", "__w")


def neutral_weights(df: DataFrame, score: str = "score", beta: str = "beta", vol: str = "vol", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The best symbol against the worst at each time (the first by name at ties), without memory."""
    first = F.row_number().over(by_time().orderBy(F.desc(score), "symbol"))
    last = F.row_number().over(by_time().orderBy(score, "symbol"))
    df = df.withColumns({"__a": first, "__b": last})
    df = df.withColumn("__raw", F.when(F.col("__a") == 1, 1.0).otherwise(0.0) - F.when(F.col("__b") == 1, 1.0).otherwise(0.0))
    return neutral(df, "__raw", beta, vol, limits, by_time()).drop("__a", "__b", "__raw")


def _inverse_volatility(df: DataFrame, signed: Column, vol: str, limits: Limits, by) -> DataFrame:
    raw = F.when(F.col(vol) > TINY, F.coalesce(signed, F.lit(0.0)) / F.when(F.col(vol) > TINY, F.col(vol))).otherwise(0.0)
    return _scaled(df.withColumn("__raw", raw), "__raw", vol, limits, by).drop("__raw")


def long_flat(df: DataFrame, score: str, vol: str, threshold: float = 0.0, limits: Limits = Limits(), by=None) -> DataFrame:  # noqa: B008
    """Inverse-volatility weights of scores above the threshold."""
    return _inverse_volatility(df, F.when(F.col(score) > threshold, 1.0), vol, limits, by or by_time())


def directional(df: DataFrame, score: str, vol: str, threshold: float = 0.0, limits: Limits = Limits(), by=None) -> DataFrame:  # noqa: B008
    return _inverse_volatility(df, F.when(F.abs(F.col(score)) > threshold, F.signum(score)), vol, limits, by or by_time())


def rebalances(times: pd.Series, every_ms: int) -> np.ndarray:
    """Position of the rebalance in force at each of the sorted times: the first, and then each that is at least
    ``every_ms`` after the one before."""
    t = times.to_numpy(np.int64)
    out, at = np.zeros(len(t), np.int64), 0
    for i in range(len(t)):
        at = i if t[i] - t[at] >= every_ms else at
        out[i] = at
    return out


def hold(df: DataFrame, by: list[str], every_ms: int, weight: str = "weight") -> DataFrame:
    """Weights of the rebalances, held until the next. The schedule is made per group from its distinct times; the
    weights are joined by it."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t").reset_index(drop=True)
        return g.assign(at=g["t"].to_numpy()[rebalances(g["t"], every_ms)])

    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), f"t {kinds['t']}", f"at {kinds['t']}"])
    plan = df.select(*by, "t").distinct().groupBy(*by).applyInPandas(run, schema)
    chosen = df.select(*by, F.col("t").alias("at"), "symbol", F.col(weight).alias("held"))
    return df.join(plan, [*by, "t"]).join(chosen, [*by, "at", "symbol"]).drop("at")


def sticky_pair(df: DataFrame, by: list[str], band: float, score: str = "score", every_ms: int = 0, least_spread: float = 0.0) -> DataFrame:
    """Best and worst symbol over time, each kept until another beats its score by more than ``band``: by, t, top,
    bottom, and at, the time of the choice. Choices are made every ``every_ms``; if the scores' spread is then below
    ``least_spread`` there is no pair, and nothing is kept.

    The choice depends on the path, so it is grouped pandas over one row a time, which holds the scores as a list; a
    group is one fold (a bounded stretch of time)."""
    names = df.select("symbol").distinct().agg(F.array_sort(F.collect_set("symbol")).alias("names"))  # the universe
    rows = df.groupBy(*by, "t").agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.col(score).cast("double")))).alias("m"))
    rows = rows.join(F.broadcast(names)).select(*by, "t", "names", F.transform("names", lambda s: F.element_at("m", s)).alias("scores"))  # names is one row

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t").reset_index(drop=True)
        symbols = np.array(g["names"].iloc[0], object)
        s = np.array([[np.nan if v is None else v for v in r] for r in g["scores"]], float)
        at = rebalances(g["t"], every_ms)
        top, bottom, a, b = np.full(len(g), -1), np.full(len(g), -1), -1, -1
        for i in range(len(g)):
            if at[i] == i:
                x = s[i]
                best, worst = int(np.nanargmax(x)), int(np.nanargmin(x))
                if x[best] - x[worst] < least_spread:
                    a = b = -1
                else:
                    a = a if a >= 0 and x[best] - x[a] <= band else best
                    b = b if b >= 0 and x[b] - x[worst] <= band else worst
                    if a == b:
                        raise ValueError("the scores have no distinct tails")
            top[i], bottom[i] = a, b
        name = lambda k: np.where(k >= 0, symbols[k], None)
        return g[[*by, "t"]].assign(top=name(top), bottom=name(bottom), at=g["t"].to_numpy()[at])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), f"t {kinds['t']}", "top string", "bottom string", f"at {kinds['t']}"])
    return rows.groupBy(*by).applyInPandas(run, schema)


def neutral_long_short(df: DataFrame, by: list[str], band: float = 0.1, every_ms: int = 0, least_spread: float = 0.0, score: str = "score", beta: str = "beta", vol: str = "vol", limits: Limits = Limits(), name: str = "weight") -> DataFrame:  # noqa: B008
    """Weights of the kept pair, from betas and volatilities at its choice, held until the next choice."""
    choice = sticky_pair(df, by, band, score, every_ms, least_spread)
    chosen = df.join(choice.where("t = at").drop("at"), [*by, "t"])
    raw = F.when(F.col("symbol") == F.col("top"), 1.0).otherwise(0.0) - F.when(F.col("symbol") == F.col("bottom"), 1.0).otherwise(0.0)
    w = neutral(chosen.withColumn("__raw", raw), "__raw", beta, vol, limits, Window.partitionBy(*by, "t"))
    w = w.select(*by, F.col("t").alias("at"), "symbol", F.col("weight").alias(name))
    out = df.join(choice.select(*by, "t", "at"), [*by, "t"]).join(w, [*by, "at", "symbol"], "left").drop("at")
    return out.withColumn(name, F.coalesce(name, F.lit(0.0)))


def buffered_long_flat(df: DataFrame, by: list[str], every_ms: int, score: str = "score", vol: str = "vol", threshold: float = 0.0, limits: Limits = Limits(), name: str = "weight") -> DataFrame:  # noqa: B008
    w = long_flat(df, score, vol, threshold, limits, Window.partitionBy(*by, "t"))
    return hold(w, by, every_ms).drop("weight").withColumnRenamed("held", name)


def buffered_directional(df: DataFrame, by: list[str], every_ms: int, score: str = "score", vol: str = "vol", threshold: float = 0.0, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    w = directional(df, score, vol, threshold, limits, Window.partitionBy(*by, "t"))
    return hold(w, by, every_ms).drop("weight").withColumnRenamed("held", "weight")


def sleeves(df: DataFrame, by: list[str], shares: dict[str, float], band: float = 0.1, every_ms: int = HOUR_MS, **given) -> DataFrame:
    """Convex mix of neutral pairs, one a score column: two or three sleeves. A score without spread is cash. df is read
    several times; give a written table."""
    if any(k < 0 for k in shares.values()) or abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares are convex")
    out = df
    for i, s in enumerate(shares):
        w = neutral_long_short(df, by, band, every_ms, 1e-12, s, name=f"__w{i}", **given)
        out = out.join(w.select(*by, "t", "symbol", f"__w{i}"), [*by, "t", "symbol"])
    total = sum((F.lit(k) * F.col(f"__w{i}") for i, k in enumerate(shares.values())), F.lit(0.0))
    return out.withColumn("weight", total).drop(*[f"__w{i}" for i in range(len(shares))])


def carry_regime(df: DataFrame, by: list[str], shares: dict[str, float], regime_score: str, regime_share: float, every_ms: int, band: float = 0.1, vol: str = "vol", limits: Limits = Limits(), **given) -> DataFrame:  # noqa: B008
    """(1 - share) of the sleeves and share of the long-flat regime trend."""
    core = sleeves(df, by, shares, band, every_ms, vol=vol, limits=limits, **given).withColumnRenamed("weight", "__core")
    trend = buffered_long_flat(df, by, every_ms, regime_score, vol, 0.0, limits, "__trend").select(*by, "t", "symbol", "__trend")
    out = core.join(trend, [*by, "t", "symbol"])
    return out.withColumn("weight", (1 - regime_share) * F.col("__core") + regime_share * F.col("__trend")).drop("__core", "__trend")


def pair_spread(legs: DataFrame, market: DataFrame, by: list[str], limits: Limits = Limits(), vol: str = "vol", most_pairs: int = 2) -> DataFrame:  # noqa: B008
    """Weights of summed pair legs, and of each pair, all scaled alike at a time, so hedge ratios stay: by, t, symbol,
    weight, pair_weights (a map). legs: by, t, other (the pair), symbol, raw; market: by, t, symbol, vol of all symbols.
    More active pairs than allowed at a time are an error."""
    active = legs.groupBy(*by, "t").agg(F.count_distinct(F.when(F.abs("raw") > TINY, F.col("other"))).alias("__active"))
    g = legs.groupBy(*by, "t", "symbol").agg(F.sum("raw").alias("__raw"), F.map_from_entries(F.collect_list(F.struct("other", "raw"))).alias("__pairs"))
    rows = market.join(g, [*by, "t", "symbol"], "left").join(active, [*by, "t"], "left")
    fine = F.coalesce(F.col("__active"), F.lit(0)) <= most_pairs
    rows = rows.withColumn("__raw", F.when(fine, F.coalesce("__raw", F.lit(0.0))).otherwise(F.raise_error(F.lit("too many active pairs"))))
    rows = _scaled(rows, "__raw", vol, limits, Window.partitionBy(*by, "t"))
    scale = F.when(F.col("__raw") != 0, F.col("weight") / F.when(F.col("__raw") != 0, F.col("__raw")))
    scale = F.max(scale).over(Window.partitionBy(*by, "t"))
    return rows.select(*by, "t", "symbol", "weight", F.transform_values(F.col("__pairs"), lambda _, v: v * F.coalesce(scale, F.lit(0.0))).alias("pair_weights"))


def sparse_state(df: DataFrame, by: list[str], entry: str, hold_rows: int, leave: str | None = None) -> DataFrame:
    """Position from sparse entries: taken at an entry while flat, kept ``hold_rows`` rows or until ``leave``; no entry
    on the row of an exit. State starts afresh in each group (a fold and symbol, or fold and pair)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        state, left, out = 0.0, 0, []
        stop = g[leave].fillna(False).to_numpy(bool) if leave else np.zeros(len(g), bool)
        for e, x in zip(g[entry].fillna(0.0).to_numpy(float), stop, strict=True):
            if state != 0.0:
                if x or left <= 0:
                    state = 0.0
                else:
                    left -= 1
            elif e != 0.0:
                state, left = float(e), hold_rows - 1
            out.append(state)
        return g.assign(position=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", position double"
    return df.groupBy(*by).applyInPandas(run, schema)


#: Policies by name; each takes rows with the columns it names and the fold as a group.
POLICIES: dict[str, Callable[..., DataFrame]] = {
    "neutral_long_short": neutral_long_short,
    "buffered_neutral_long_short": neutral_long_short,
    "buffered_long_flat": buffered_long_flat,
    "buffered_directional": buffered_directional,
    "buffered_two_sleeve_neutral": sleeves,
    "buffered_three_sleeve_neutral": sleeves,
    "buffered_carry_regime": carry_regime,
    "buffered_pair_spread": pair_spread,
}
