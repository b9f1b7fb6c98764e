"""As-of, interval, range and alignment joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS
from .windows import previous, same


def asof(left: DataFrame, right: DataFrame, keys: dict[str, str], left_t: str, right_t: str, values: list[str], name: str, width: int) -> DataFrame:
    """Adds ``name``, the struct of ``values`` of the latest right row with right_t <= left_t; null if there is none.

    keys: left column to right column, or none, if all rows are of one series. Times are numbers. Both sides meet by key
    and bucket of ``width`` of time, one union and one window; a bucket is handed the last right row of those before it,
    of which there is one row a bucket. So one key that all rows share is many tasks' work. At equal times right rows
    come first; of right rows of one key and time the greatest (by values) counts."""
    k = [f"__k{i}" for i in range(len(keys))]
    bucket = lambda t: F.floor(F.col(t) / F.lit(width)).alias("__bucket")
    item = F.struct(*values)
    r = right.where(F.col(right_t).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(keys.values(), k, strict=True)], F.col(right_t).alias("__t"), bucket(right_t), item.alias("__v"), F.lit(0).alias("__side"))
    rows = left.select(F.struct("*").alias("__row"), *[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)], F.col(left_t).alias("__t"), bucket(left_t), F.lit(1).alias("__side"))
    both = r.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(*k, "__bucket").orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__in", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    ends = r.groupBy(*k, "__bucket").agg(F.max(F.struct("__t", "__v")).alias("__end"))
    # The buckets of left rows too, so that each finds what was handed on to it.
    known = ends.unionByName(rows.select(*k, "__bucket").distinct(), allowMissingColumns=True).groupBy(*k, "__bucket").agg(F.max("__end").alias("__end"))
    handed = F.last("__end", ignorenulls=True).over(Window.partitionBy(*k).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    carry = known.withColumn("__carry", handed)
    out = inside.alias("l").join(carry.alias("r"), same("l", "r", [*k, "__bucket"]))
    return out.select("__row.*", F.when(F.col("__t").isNotNull(), F.coalesce("__in", "__carry.__v")).alias(name))


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_t: str, right_t: str, value: str, width: int = 30 * DAY_MS) -> DataFrame:
    """Adds ``value`` of the latest right row with right_t <= left_t, and ``change`` against the one before it. Right rows
    of one time are summed first. A left row without any stays, with nulls. Times are numbers, or timestamps for both."""
    number = lambda df, t: F.col(t) if df.schema[t].dataType.typeName() not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(F.col(t).cast("timestamp")) / 1000
    r = right.groupBy(F.col(key).alias("__rk"), number(right, right_t).alias("__rt")).agg(F.sum(value).alias("__rv"))
    r = previous(r.where("__rt IS NOT NULL"), ["__rk"], ["__rt"], ["__rv"], width).withColumn("__change", F.col("__rv") - F.col("prev.__rv"))
    timed = left.withColumn("__lt", number(left, left_t))
    out = asof(timed, r, {key: "__rk"}, "__lt", "__rt", ["__rv", "__change"], "__last", width)
    return out.select(*left.columns, F.col("__last.__rv").alias(value), F.col("__last.__change").alias("change"))


def interval_sum(left: DataFrame, right: DataFrame, key: str, start: str, end: str, right_t: str, value: str, name: str, width: int) -> DataFrame:
    """Adds the sum of ``value`` over right rows in (start, end], 0 if none or an end is missing. Times are integers.

    Time is cut into buckets of ``width`` (about the length of an interval); both sides meet by key and bucket, so an
    interval sees the rows near it only, and each sum is of its own rows: no running totals, whose differences lose
    small values beside large ones and spread a NaN over all that follows."""
    r = right.groupBy(F.col(key).alias("__k"), F.col(right_t).cast("long").alias("__t")).agg(F.sum(value).alias("__v"))
    r = r.withColumn("__bucket", F.floor(F.col("__t") / width))
    a, z = F.col(start).cast("long"), F.col(end).cast("long")
    spans = left.select(F.col(key).alias("__k"), a.alias("__a"), z.alias("__z")).where("__a < __z").distinct()
    near = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("__a") / width), F.floor(F.col("__z") / width))))
    met = near.join(r, ["__k", "__bucket"]).where("__t > __a AND __t <= __z")
    sums = met.groupBy("__k", "__a", "__z").agg(F.sum("__v").alias("__sum"))
    out = left.join(sums, (F.col(key) == F.col("__k")) & (a == F.col("__a")) & (z == F.col("__z")), "left")
    return out.withColumn(name, F.coalesce("__sum", F.lit(0.0))).drop("__k", "__a", "__z", "__sum")


def with_folds(df: DataFrame, folds: DataFrame, t: str, low: str, high: str, width: int = 7 * DAY_MS) -> DataFrame:
    """Rows joined with every fold whose closed interval holds their time. Folds are spread over the stretches of
    ``width`` that they reach into, so this is an equality join, whatever their number."""
    spread = folds.withColumn("__week", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    near = df.withColumn("__week", F.floor(F.col(t) / width))
    return near.join(spread, "__week").where(F.col(t).between(F.col(low), F.col(high))).drop("__week")


def dense_panel(df: DataFrame, symbols: list[str]) -> DataFrame:
    """All times by all (configured) symbols, with ``available`` and the first reason why not: a row that is missing, or
    one of the flags is_available, lookback_ok, quality_ok, liquidity_ok where df has it and it is not true."""
    grid = df.select("t").distinct().withColumn("symbol", F.explode(F.array(*map(F.lit, symbols))))
    out = grid.join(df.withColumn("__there", F.lit(True)), ["t", "symbol"], "left")
    reason = F.when(F.col("__there").isNull(), "missing_panel_row")
    for flag in ("is_available", "lookback_ok", "quality_ok", "liquidity_ok"):
        if flag in df.columns:
            reason = reason.when(~F.coalesce(F.col(flag), F.lit(False)), flag)
    return out.withColumn("reason", reason).withColumn("available", F.col("reason").isNull()).drop("__there")


def masked_correlation(a: DataFrame, b: DataFrame, x: str, mask: str, least: int = 30) -> DataFrame:
    """Correlation of x over rows of both (t, symbol) whose masks hold on both sides; null under ``least`` or without spread."""
    j = a.where(mask).select("t", "symbol", F.col(x).alias("l")).join(b.where(mask).select("t", "symbol", F.col(x).alias("r")), ["t", "symbol"])
    ok = (F.count("*") >= least) & (F.stddev_pop("l") > 1e-18) & (F.stddev_pop("r") > 1e-18)
    return j.agg(F.count("*").alias("n"), F.when(ok, F.corr("l", "r")).alias("correlation"))


def with_features(trades: DataFrame, features: DataFrame, at: str = "entry", t: str = "execution_time_ms") -> DataFrame:
    """Trades with the features of their symbol at their time; a trade without any stays."""
    f = features.withColumnsRenamed({t: "__t", "symbol": "__s"})
    return trades.join(f, (F.col(at) == F.col("__t")) & (F.col("symbol") == F.col("__s")), "left").drop("__t", "__s")


def to_matrix(df: DataFrame, value: str, symbols: list[str]) -> DataFrame:
    return df.groupBy("t").pivot("symbol", symbols).agg(F.first(value))


def to_long(matrix: DataFrame, symbols: list[str], value: str) -> DataFrame:
    return matrix.unpivot("t", symbols, "symbol", value).where(F.col(value).isNotNull())


def common_times(df: DataFrame, by: str, t: str) -> DataFrame:
    """Times that every series has, with each series' share of its own times that are common."""
    n = df.select(by).distinct().agg(F.count("*").alias("n"))
    full = df.groupBy(t).agg(F.count_distinct(by).alias("c")).join(F.broadcast(n)).where("c = n").select(t)
    marked = df.select(by, t).distinct().join(full.withColumn("__in", F.lit(1)), t, "left")
    return marked.groupBy(by).agg(F.count("*").alias("original"), F.count("__in").alias("aligned")).withColumn("coverage", F.col("aligned") / F.col("original"))


def correlation_pairs(df: DataFrame, by: str, t: str, x: str, least: int = 30) -> DataFrame:
    """Pearson correlation of every ordered pair of series at common times; null under ``least`` or without spread."""
    a, b = (df.select(F.col(t), F.col(by).alias(f"{side}_id"), F.col(x).alias(side)) for side in ("left", "right"))
    g = a.join(b, t).groupBy("left_id", "right_id").agg(F.count("*").alias("n"), F.stddev_pop("left").alias("sl"), F.stddev_pop("right").alias("sr"), F.corr("left", "right").alias("c"))
    return g.select("left_id", "right_id", "n", F.when((F.col("n") >= least) & (F.col("sl") > 1e-18) & (F.col("sr") > 1e-18), F.col("c")).alias("correlation"))


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only; empty means equal key sets."""
    j = a.select(*keys).distinct().withColumn("__a", F.lit(1)).join(b.select(*keys).distinct().withColumn("__b", F.lit(1)), keys, "full")
    return j.where("__a IS NULL OR __b IS NULL").select(*keys, F.when(F.col("__a").isNull(), "right").otherwise("left").alias("only"))


def parameter_grid(spark, axes: dict[str, list[float]], total: float | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Combinations of a few parameter values, with those whose sum misses ``total`` left out, numbered in order."""
    out = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(float(v),) for v in values], f"{name} double")
        out = axis if out is None else out.crossJoin(axis)  # sizes are those of the declared lists
    if total is not None:
        out = out.where(F.abs(sum(F.col(n) for n in axes) - total) <= tolerance)
    return out.withColumn("ordinal", F.row_number().over(Window.orderBy(*axes)))


def tagged_union(frames: dict[str, DataFrame], tag: str = "tag") -> DataFrame:
    """Rows of all frames with their names as ``tag``: columns meet by name, what a frame lacks is null, and columns of
    different types take the type that holds both (of an integer and a double, a double)."""
    tagged = [df.select(F.lit(name).alias(tag), "*") for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
