"""Named feature bundles over bars, a registry of them, and plans that run them in order.

Bars (symbol, t, open, high, low, close, quote_volume, taker_quote_volume; t the opening time) are first folded into
decision rows, one for each symbol and hour of ``hour`` bars. All windows of the bundles are over decision rows by
symbol; only the market benchmark and regime are windows by time. Series are cut into parts that carry the rows that their
windows reach back to (windows.with_halo), bars as well as decision rows, so few long series are many tasks. A bundle is
a function from decision rows to decision rows with more columns.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS, MINUTE_MS, TINY, log, only_finite, quotient
from ..sources.files import staged
from . import windows as wn

HOURS_A_YEAR = 8760.0
#: Decision rows go to neighbouring parts of their series by stretches of a week.
HALO_MS = 7 * DAY_MS


def decision_rows(bars: DataFrame, hour: int = 60, step_ms: int = MINUTE_MS) -> DataFrame:
    """One row per symbol and complete hour: its bars' totals, extremes and last close, and what is needed of the bars
    after it for labels (opening prices one bar and one hour and a bar later, volume of the hour between).

    t is the close of the hour's last bar. An hour without all its bars gives no row. The logarithm of a price of zero is
    minus infinity, so returns to and from it are infinite and so are what is summed of them."""
    bars = wn.with_halo(bars, 15, hour + 1)
    w = wn.by_symbol(bars)
    close, start = log(F.col("close")), log(F.col("open"))
    signed = 2 * F.col("taker_quote_volume") - F.col("quote_volume")
    step = close - F.lag(close).over(w)
    phase = F.pmod(F.floor(F.col("t") / step_ms), F.lit(hour))
    quarter = phase % (hour // 4) == 0
    ahead = w.rowsBetween(1, hour)
    rows = bars.select(
        "symbol", "t", wn.PART, wn.OWN, "open", "high", "low", "close", "quote_volume", "taker_quote_volume",
        close.alias("ln_close"), (step * step).alias("r2"),
        *[(close - F.lag(close, m).over(w)).alias(f"ret_{m}") for m in (5, 15)],
        F.when(quarter, signed).alias("q_signed"), F.when(quarter, F.col("quote_volume")).alias("q_volume"),
        F.when(~quarter, signed).alias("o_signed"), F.when(~quarter, F.col("quote_volume")).alias("o_volume"),
        F.when(quarter, close - start).alias("q_return"), signed.alias("signed"),
        F.lead("t").over(w).alias("execution_t"), F.lead("open").over(w).alias("execution_open"),
        F.lead("t", 1 + hour).over(w).alias("label_end_t"), F.lead("open", 1 + hour).over(w).alias("label_open"),
        F.when(F.count("quote_volume").over(ahead) == hour, F.sum("quote_volume").over(ahead)).alias("ahead_volume"),
    )
    last = ["close", "ln_close", "ret_5", "ret_15", "execution_t", "execution_open", "label_end_t", "label_open", "ahead_volume"]
    total = ["r2", "signed", "quote_volume", "taker_quote_volume", "q_signed", "q_volume", "o_signed", "o_volume", "q_return"]
    g = wn.own(rows).groupBy("symbol", F.floor(F.col("t") / (hour * step_ms)).alias("hour")).agg(
        F.count("*").alias("n"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by(F.struct(*last), "t").alias("at"),
        *[F.sum(c).alias(c) for c in total],
    )
    return g.where(F.col("n") == hour).select("symbol", ((F.col("hour") + 1) * hour * step_ms - 1).alias("t"), "high", "low", *[F.col(f"at.{c}").alias(c) for c in last], *total)


def _ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    return F.when(b > least, a / F.when(b > least, b))


def returns_momentum(df: DataFrame, leaders: tuple[str, str], beta_hours: int = 168) -> DataFrame:
    """Log returns, the leaders' mean return (each leader against the other), beta on it, and residuals."""
    w = wn.by_symbol(df)
    df = df.withColumns({"log_return_5m": F.col("ret_5"), "log_return_15m": F.col("ret_15")} | {f"log_return_{h}h": F.col("ln_close") - F.lag("ln_close", h).over(w) for h in (1, 4, 24)})
    df = wn.benchmark(df, "log_return_1h", *leaders).withColumnRenamed("bench", "benchmark_return_1h")
    df = df.withColumn("rolling_beta", wn.rolling_beta(F.col("log_return_1h"), F.col("benchmark_return_1h"), beta_hours, w))
    df = df.withColumn("residual_momentum_1h", F.col("log_return_1h") - F.col("rolling_beta") * F.col("benchmark_return_1h"))
    return df.withColumns({f"residual_momentum_{h}h": wn.trailing_sum(F.col("residual_momentum_1h"), h, 0, w) for h in (4, 24)})


def volatility(df: DataFrame, leaders: tuple[str, str]) -> DataFrame:
    """Realised volatility of a day's bars, range of four hours (infinite if a low is zero), and the leaders' annual
    volatility for all symbols."""
    w = wn.by_symbol(df)
    day, range_ = w.rowsBetween(-23, 0), w.rowsBetween(-3, 0)
    full = F.row_number().over(w)
    df = df.withColumns({
        "realized_volatility_24h": F.when(full >= 24, F.sqrt(F.sum("r2").over(day))),
        "intraday_range_4h": F.when(full >= 4, quotient(F.max("high").over(range_), F.min("low").over(range_)) - 1),
    })
    # Every symbol carries the market's return of its hours, so its own window gives the market's volatility; hours that
    # the symbol lacks would change it, so the market's series has its own rows, one an hour.
    once = df.where(wn.OWN) if wn.OWN in df.columns else df
    market = once.where(F.col("symbol").isin(*leaders)).groupBy("t").agg(F.count(only_finite(F.col("log_return_1h"))).alias("n"), F.avg("log_return_1h").alias("m"))
    market = market.withColumn("m", F.when(F.col("n") == 2, F.col("m"))).withColumn("symbol", F.lit(""))
    market = wn.with_halo(market, 24)
    regime = (wn.rolling_std(F.col("m"), 24, wn.by_symbol(market)) * HOURS_A_YEAR**0.5).alias("market_volatility_regime")
    return df.join(wn.own(market.select("t", regime, wn.PART, wn.OWN)), "t", "left")


def volume(df: DataFrame) -> DataFrame:
    df = df.withColumn("quote_volume_1h", F.col("quote_volume"))
    return df.withColumn("quote_volume_zscore_24h", wn.rolling_zscore(F.col("quote_volume_1h"), 24, wn.by_symbol(df)))


def microstructure(df: DataFrame) -> DataFrame:
    return df.withColumn("taker_buy_imbalance_1h", _ratio(2 * F.col("taker_quote_volume"), F.col("quote_volume_1h")) - 1)


def funding(df: DataFrame, rates: DataFrame) -> DataFrame:
    """Latest rate at or before t and its change. rates: symbol, funding_t, funding_rate."""
    from .joins import asof_backward

    out = asof_backward(df, rates, "symbol", "t", "funding_t", "funding_rate")
    return out.withColumnsRenamed({"funding_rate": "funding_rate_current", "change": "funding_rate_change"})


def clock_phase(df: DataFrame) -> DataFrame:
    """Flow and return of the bars that open a quarter of the hour, against the others."""
    df = df.withColumns({
        "quarter_open_signed_flow_1h": F.col("q_signed"),
        "quarter_open_quote_volume_1h": F.col("q_volume"),
        "quarter_open_flow_share_1h": _ratio(F.col("q_signed"), F.col("q_volume")),
        "non_open_flow_share_1h": _ratio(F.col("o_signed"), F.col("o_volume")),
        "quarter_open_return_1h": F.col("q_return"),
    }).withColumn("quarter_flow_excess_1h", F.col("quarter_open_flow_share_1h") - F.col("non_open_flow_share_1h"))
    return df.withColumns({
        "quarter_open_flow_z_168h": wn.rolling_zscore(F.col("quarter_open_flow_share_1h"), 168, wn.by_symbol(df)),
        "quarter_flow_excess_z_168h": wn.rolling_zscore(F.col("quarter_flow_excess_1h"), 168, wn.by_symbol(df)),
    })


def flow(df: DataFrame) -> DataFrame:
    df = df.withColumn("signed_taker_flow_share_1h", _ratio(F.col("signed"), F.col("quote_volume_1h")))
    df = df.withColumn("signed_taker_flow_z_168h", wn.rolling_zscore(F.col("signed_taker_flow_share_1h"), 168, wn.by_symbol(df)))
    df = df.withColumn("hourly_volatility_proxy", F.col("realized_volatility_24h") / 24**0.5)
    scale = F.when(F.col("hourly_volatility_proxy").isNotNull(), F.greatest("hourly_volatility_proxy", F.lit(TINY)))
    df = df.withColumn("vol_scaled_return_1h", F.col("log_return_1h") / scale)
    return df.withColumn("flow_price_agreement_1h", F.signum("signed_taker_flow_z_168h") * F.col("vol_scaled_return_1h"))


def path_state(df: DataFrame) -> DataFrame:
    r = F.col("log_return_1h")
    df = df.withColumns({f"realized_volatility_{n}h": wn.realized_volatility(r, n, wn.by_symbol(df)) for n in (4, 168)})
    base = F.greatest(F.col("realized_volatility_168h") * (4 / 168) ** 0.5, F.when(F.col("realized_volatility_168h").isNotNull(), F.lit(TINY)))
    high, low = wn.prior_extrema(F.col("high"), F.col("low"), 72, wn.by_symbol(df))
    df = df.withColumns({"volatility_compression_4h_168h": F.col("realized_volatility_4h") / base, "prior_high_72h": high, "prior_low_72h": low})
    df = df.withColumn("range_position_72h", _ratio(F.col("close") - F.col("prior_low_72h"), F.col("prior_high_72h") - F.col("prior_low_72h"), TINY))
    return wn.efficiency(df, "ln_close", 24, "efficiency_ratio_24h")


def pair_state(df: DataFrame) -> DataFrame:
    return df.withColumn("log_close_level", F.col("ln_close"))


@dataclass(frozen=True)
class Bundle:
    """A versioned function that adds ``outputs`` and reads ``needs`` of other bundles. ``tables`` are further inputs
    and ``parameters`` its keyword arguments; a value "$name" is taken from the plan's settings. ``back`` is how many
    rows of its series before a row its windows reach, one on the other; a setting's name, given so, adds its value."""

    name: str
    version: str
    compute: Callable[..., DataFrame]
    outputs: tuple[str, ...]
    needs: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    back: tuple[int | str, ...] = (0,)

    def reach(self, settings: dict) -> int:
        return sum(settings[x[1:]] if isinstance(x, str) else x for x in self.back)


BUNDLES = (
    Bundle("returns_momentum", "v1", returns_momentum, (*(f"log_return_{x}" for x in ("5m", "15m", "1h", "4h", "24h")), "benchmark_return_1h", "rolling_beta", *(f"residual_momentum_{h}h" for h in (1, 4, 24))), parameters={"leaders": "$leaders", "beta_hours": "$beta_hours"}, back=(24, "$beta_hours", 24)),
    Bundle("volatility", "v1", volatility, ("realized_volatility_24h", "intraday_range_4h", "market_volatility_regime"), ("log_return_1h",), parameters={"leaders": "$leaders"}, back=(24,)),
    Bundle("volume", "v1", volume, ("quote_volume_1h", "quote_volume_zscore_24h"), back=(24,)),
    Bundle("microstructure", "v1", microstructure, ("taker_buy_imbalance_1h",), ("quote_volume_1h",)),
    Bundle("funding", "v1", funding, ("funding_rate_current", "funding_rate_change"), tables=("rates",)),
    Bundle("clock_phase", "v1", clock_phase, (*(f"quarter_open_{x}_1h" for x in ("signed_flow", "quote_volume", "flow_share", "return")), "non_open_flow_share_1h", "quarter_flow_excess_1h", "quarter_open_flow_z_168h", "quarter_flow_excess_z_168h"), back=(168,)),
    Bundle("flow", "v1", flow, ("signed_taker_flow_share_1h", "signed_taker_flow_z_168h", "hourly_volatility_proxy", "vol_scaled_return_1h", "flow_price_agreement_1h"), ("quote_volume_1h", "realized_volatility_24h", "log_return_1h"), back=(168,)),
    Bundle("path_state", "v1", path_state, ("realized_volatility_4h", "realized_volatility_168h", "volatility_compression_4h_168h", "prior_high_72h", "prior_low_72h", "range_position_72h", "efficiency_ratio_24h"), ("log_return_1h",), back=(168, 2)),
    Bundle("pair_state", "v1", pair_state, ("log_close_level",)),
)


class Registry:
    """One active version a bundle name; every output belongs to one active bundle."""

    def __init__(self, bundles=BUNDLES):
        self.active: dict[str, Bundle] = {}
        for b in bundles:
            self.register(b)

    def register(self, bundle: Bundle, replace: bool = False) -> None:
        if bundle.name in self.active and not replace:
            raise ValueError(f"{bundle.name} has an active version")
        taken = {o for n, b in self.active.items() if n != bundle.name for o in b.outputs} & set(bundle.outputs)
        if taken:
            raise ValueError(f"outputs of another bundle: {sorted(taken)}")
        self.active[bundle.name] = bundle

    def owner(self, output: str) -> Bundle:
        for b in self.active.values():
            if output in b.outputs:
                return b
        raise ValueError(f"unknown feature {output}")

    def plan(self, features: list[str]) -> list[Bundle]:
        """The bundles that make the features, each after those it needs."""
        order: list[Bundle] = []

        def add(bundle: Bundle, above: tuple[str, ...]) -> None:
            if bundle.name in above:
                raise ValueError(f"{bundle.name} needs itself")
            if bundle not in order:
                for n in bundle.needs:
                    add(self.owner(n), (*above, bundle.name))
                order.append(bundle)

        for f in features:
            add(self.owner(f), ())
        return order

    def checksum(self, features: list[str]) -> str:
        """Of the set: the order of features does not matter, versions do."""
        named = sorted(f"{f}:{self.owner(f).version}" for f in set(features))
        return hashlib.sha256(json.dumps(named).encode()).hexdigest()

    def compute(self, rows: DataFrame, features: list[str], settings: dict, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """symbol, t, the features, and the decision rows' own columns. Series are cut so that a part has the rows before
        it that all bundles of the plan reach back to, one on the other."""
        plan = self.plan(features)
        rows = wn.with_halo(staged(rows), sum(b.reach(settings) for b in plan), width=HALO_MS)
        for b in plan:
            missing = [n for n in b.needs if n not in rows.columns]
            if missing:
                raise ValueError(f"{b.name} lacks {missing}")
            given = {k: settings[v[1:]] if isinstance(v, str) and v.startswith("$") else v for k, v in b.parameters.items()}
            rows = b.compute(rows, **given, **{t: (tables or {})[t] for t in b.tables})
            lost = [o for o in b.outputs if o not in rows.columns]
            if lost:
                raise ValueError(f"{b.name} did not make {lost}")
        return wn.own(rows)


def output_faults(df: DataFrame, features: list[str]) -> DataFrame:
    """By feature: rows, infinite values, and whether no value is there. One pass."""
    each = [F.struct(F.lit(f).alias("feature"), F.count_if(F.abs(F.col(f).cast("double")) == float("inf")).alias("infinite"), (F.count(only_finite(F.col(f))) == 0).alias("empty")) for f in features]
    return df.agg(F.count("*").alias("n_rows"), F.array(*each).alias("x")).select("n_rows", F.explode("x").alias("x")).select("x.*", "n_rows")


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are all finite numbers."""
    return df.where(reduce(Column.__and__, [only_finite(F.col(c)).isNotNull() for c in columns]))


def known_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are all there, infinite ones included."""
    return df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))


def feature_view(df: DataFrame, features: list[str], keys: tuple[str, ...] = ("symbol", "t"), outcomes: tuple[str, ...] = ("future_", "outcome_", "label_"), roles: dict[str, str] | None = None, registry: Registry | None = None) -> DataFrame:
    """Keys and features only. An error: an outcome among the features, by its name or by its role in ``roles`` (column to
    key, feature, target or time; a column without a role is a feature), a feature that ``registry`` does not know, one
    named twice or also a key, and a column that df lacks."""
    leaked = [f for f in features if f.startswith(outcomes)]
    if leaked:
        raise ValueError(f"outcomes are no features: {leaked}")
    other = [f for f in features if f in keys or (roles or {}).get(f, "feature") != "feature"]
    if other or len(set(features)) < len(features):
        raise ValueError(f"no features, or named twice: {other or features}")
    for f in features if registry else ():
        registry.owner(f)
    missing = [c for c in (*keys, *features) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*keys, *features)


def key_faults(df: DataFrame, keys: tuple[str, ...] = ("symbol", "t")) -> DataFrame:
    """One row: rows, rows that lack a part of their key, and rows beyond the first of a key."""
    lacks = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    g = df.groupBy(*keys, lacks.alias("__lacks")).agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return g.agg(zero(F.col("n"))("n_rows"), zero(F.when(F.col("__lacks"), F.col("n")))("incomplete"), zero(F.when(~F.col("__lacks"), F.col("n") - 1))("repeated"))


def target_view(df: DataFrame, target: str, keys: tuple[str, ...] = ("symbol", "t")) -> DataFrame:
    return df.select(*keys, target)


def labels(df: DataFrame, leaders: tuple[str, str], rates: DataFrame | None = None, hour_ms: int = 60 * MINUTE_MS) -> DataFrame:
    """Outcomes of the hour after the next bar's opening, and their times.

    future_return_1h, future_residual_return_1h (less beta times the leaders' mean, each leader against the other),
    outcome_quote_volume_1h, outcome_funding_rate_1h (rates in (execution, label end]), execution_time_ms,
    label_end_time_ms. df: decision rows with rolling_beta. A return from a price of zero is infinite, or no number."""
    from .joins import interval_sum

    df = df.withColumn("future_return_1h", quotient(F.col("label_open"), F.col("execution_open")) - 1)
    df = wn.benchmark(df, "future_return_1h", *leaders)
    df = df.withColumn("future_residual_return_1h", F.col("future_return_1h") - F.col("rolling_beta") * F.col("bench")).drop("bench")
    df = df.withColumns({"outcome_quote_volume_1h": F.col("ahead_volume"), "execution_time_ms": F.col("execution_t"), "label_end_time_ms": F.col("label_end_t")})
    if rates is None:
        return df.withColumn("outcome_funding_rate_1h", F.lit(0.0))
    return interval_sum(df, rates, "symbol", "execution_time_ms", "label_end_time_ms", "funding_t", "funding_rate", "outcome_funding_rate_1h", hour_ms)


LABELS = ("future_return_1h", "future_residual_return_1h", "outcome_quote_volume_1h")


def dataset(df: DataFrame, features: list[str], n_symbols: int, source_ms: int, kept: Callable[[DataFrame, list[str]], DataFrame] = finite_rows) -> DataFrame:
    """Research rows: times, features and outcomes of rows that are all finite (or those that ``kept`` keeps), at times
    that all symbols have."""
    from .bars import complete_times

    times = {"decision_time_ms": F.col("t"), "feature_source_min_ms": F.col("t") + 1 - source_ms, "feature_source_max_ms": F.col("t")}
    rows = kept(df.withColumns(times), [*features, *LABELS]).where("label_end_time_ms IS NOT NULL")
    return complete_times(rows, n_symbols).select("symbol", "t", *times, "execution_time_ms", "label_end_time_ms", *features, *LABELS, "outcome_funding_rate_1h")


def point_in_time_audit(df: DataFrame, features: list[str]) -> DataFrame:
    """Counts of rows that know the future, of repeated keys and of missing features, and whether times are complete."""
    bad = {
        "feature_after_cutoff": F.col("feature_source_max_ms") > F.col("decision_time_ms"),
        "execution_not_after_decision": F.col("execution_time_ms") <= F.col("decision_time_ms"),
        "label_not_after_execution": F.col("label_end_time_ms") <= F.col("execution_time_ms"),
    }
    keys = df.groupBy("decision_time_ms", "symbol").agg(
        F.count("*").alias("n"),
        *[F.count_if(c).alias(k) for k, c in bad.items()],
        F.sum(sum((F.col(f).isNull().cast("long") for f in features), F.lit(0))).alias("nulls"),
    )
    g = keys.groupBy("decision_time_ms").agg(F.sum("n").alias("n"), F.count("*").alias("symbols"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"), *[F.sum(k).alias(k) for k in (*bad, "nulls")])
    return g.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_decisions"), F.sum("repeated").alias("duplicate_keys"), *[F.sum(k).alias(k) for k in bad], F.sum("nulls").alias("null_features"),
        (F.min("symbols") == F.max("symbols")).alias("complete"), F.min("decision_time_ms").alias("first_ms"), F.max("decision_time_ms").alias("last_ms"),
    )


def sample_decisions(df: DataFrame, every_ms: int) -> DataFrame:
    """Rows whose time closes an interval."""
    return df.where((F.col("t") + 1) % every_ms == 0)


def blend_means(df: DataFrame, features: list[str], weights: list[list[float]]) -> DataFrame:
    """trial, mean magnitude of each weighted blend of the features: many trials in one pass. Each task multiplies its
    batches, as they come, by the matrix of weights and hands on one partial sum a trial. Rows in which a feature is null
    or no number are out."""
    w = np.asarray(weights, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(w)), 0
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float, copy=False)
            bad = np.isnan(x).any(axis=0)
            x = x[:, ~bad] if bad.any() else x
            total += np.abs(w @ x).sum(axis=1)
            n += x.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))], ["trial", "s", "n"])

    rows = df.select(*features)  # in their own types: half the bytes to move where they are floats
    return rows.mapInArrow(run, "trial int, s double, n long").groupBy("trial").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean_abs"))
