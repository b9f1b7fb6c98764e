"""Canonical bars: building, contract filters and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS, HOUR_MS, epoch_ms, finite


def bars(events: DataFrame, step_ms: int = HOUR_MS) -> DataFrame:
    """Bars of an event table (event_type as the symbol): symbol, t, open, high, low, close, volume, trades.

    One pre-aggregated shuffle; first and last are chosen by (ts, event_id), so ties are settled."""
    at = F.struct("ts", "event_id")
    t = (F.floor(epoch_ms(F.col("ts")) / step_ms) * step_ms).cast("long")
    return events.groupBy(F.col("event_type").alias("symbol"), t.alias("t")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
        F.sum("value").alias("volume"), F.count("*").alias("trades"),
    )


def returns(b: DataFrame) -> DataFrame:
    """Adds r, the log return over the previous bar of the symbol."""
    return b.withColumn("r", F.ln("close") - F.ln(F.lag("close").over(Window.partitionBy("symbol").orderBy("t"))))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first in source order (dropDuplicates keeps any)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest_revision(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row a key: the one with the greatest version, by a pre-aggregated max_by rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__r"))
    return one.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def snapshot_as_of(df: DataFrame, keys: list[str], valid_from: str, as_of: Column, ties: list[str] = ()) -> DataFrame:
    """One row a key: the latest that is valid at ``as_of``, by ``valid_from`` and then ``ties``; keys that have none yet are left out."""
    rest = [c for c in df.columns if c not in keys]
    known = df.where(F.col(valid_from) <= as_of)
    one = known.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(valid_from, *ties)).alias("__r"))
    return one.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, distinct_keys, surplus_rows, rows_in_duplicate_groups."""
    g = df.groupBy(*keys).agg(F.count("*").alias("c"))
    return g.agg(F.sum("c").alias("n_rows"), F.count("*").alias("distinct_keys"), (F.sum("c") - F.count("*")).alias("surplus_rows"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("rows_in_duplicate_groups"))


def out_of_order(df: DataFrame, by: list[str], position: str, t: str, width: int = 1 << 20) -> DataFrame:
    """Rows per group whose time is before that of the row before them in source order; position is a number."""
    from .windows import previous

    d = previous(df.select(*dict.fromkeys([*by, position, t])), by, [position], [t], width)
    return d.groupBy(*by).agg(F.count_if(F.coalesce(F.col(t) < F.col(f"prev.{t}"), F.lit(False))).cast("long").alias("out_of_order"))


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_nulls") for c in df.columns])


def audit_predicates(step_ms: int = HOUR_MS, start_ms: int | None = None, end_ms: int | None = None) -> dict[str, Column]:
    """Named faults of a bar row, over the columns that the bars have: a missing column's rule is left out by audit_bars."""
    o, h, lo, c, v, t = (F.col(x) for x in ("open", "high", "low", "close", "volume", "t"))
    out = {
        "not_finite": ~reduce(Column.__and__, [finite(x) for x in (o, h, lo, c, v)]),
        "negative_price": F.least(o, h, lo, c) < 0,
        "negative_volume": v < 0,
        "negative_trades": F.col("trades") < 0,
        "invalid_ohlc": (lo > F.least(o, c)) | (h < F.greatest(o, c)) | (lo > h),
        "misaligned": t % step_ms != 0,
        "close_not_after_open": F.col("close_t") <= t,
        "negative_quote_volume": F.col("quote_volume") < 0,
        "negative_taker_volume": F.least("taker_buy_volume", "taker_buy_quote_volume") < 0,
        "taker_above_total": (F.col("taker_buy_volume") > v) | (F.col("taker_buy_quote_volume") > F.col("quote_volume")),
        "not_closed": ~F.col("is_closed"),
        "empty_with_volume": (F.col("trades") == 0) & (v > 0),
    }
    if start_ms is not None and end_ms is not None:
        out["out_of_range"] = (t < start_ms) | (t > end_ms // step_ms * step_ms)
    return out


_AUDITED = {"negative_trades": ("trades",), "close_not_after_open": ("close_t",), "negative_quote_volume": ("quote_volume",), "negative_taker_volume": ("taker_buy_volume", "taker_buy_quote_volume"), "taker_above_total": ("taker_buy_volume", "taker_buy_quote_volume", "quote_volume"), "not_closed": ("is_closed",), "empty_with_volume": ("trades",)}


def audit_bars(b: DataFrame, step_ms: int = HOUR_MS, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Counts of every fault by symbol in one aggregation."""
    rules = {n: p for n, p in audit_predicates(step_ms, start_ms, end_ms).items() if set(_AUDITED.get(n, ())) <= set(b.columns)}
    return b.groupBy("symbol").agg(F.count("*").alias("n_bars"), *[F.count_if(F.coalesce(p, F.lit(False))).alias(n) for n, p in rules.items()])


def gaps(b: DataFrame, start_ms: int, end_ms: int, step_ms: int = HOUR_MS) -> DataFrame:
    """missing_bars and gap_events by symbol over [start, end), leading and trailing gaps included."""
    times = b.where(F.col("t").between(start_ms, end_ms - 1)).select("symbol", "t").distinct()
    w = Window.partitionBy("symbol").orderBy("t")
    step = F.floor((F.col("t") - F.lag("t", 1, start_ms - step_ms).over(w)) / step_ms) - 1
    each = times.withColumn("lost", step)
    tail = F.floor((F.lit(end_ms) - F.max("t")) / step_ms) - 1
    return each.groupBy("symbol").agg((F.sum("lost") + tail).cast("long").alias("missing_bars"), (F.count_if(F.col("lost") > 0) + (tail > 0).cast("int")).cast("long").alias("gap_events"))


def complete_times(b: DataFrame, n_symbols: int) -> DataFrame:
    """Rows at times that all symbols have (a semi join with pre-aggregated keys)."""
    full = b.groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") == n_symbols).select("t")
    return b.join(full, "t", "left_semi")


def contract_faults(b: DataFrame, step_ms: int = HOUR_MS, width: int = 30 * DAY_MS) -> DataFrame:
    """By symbol: repeated times, steps longer and shorter than a bar, rows whose prices are no positive numbers, rows
    that are not closed (where the bars say so), and whether its times are the grid of all symbols."""
    from .windows import previous

    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    bad = ~reduce(Column.__and__, [finite(x) & (x > 0) for x in (o, h, lo, c)])
    still_open = ~F.coalesce(F.col("is_closed"), F.lit(False)) if "is_closed" in b.columns else F.lit(False)
    rows = b.select("symbol", "t", F.coalesce(bad, F.lit(True)).alias("bad"), still_open.alias("still_open"))
    d = F.col("t") - F.col("prev.t")
    each = previous(rows, ["symbol"], ["t", "bad", "still_open"], ["t"], width).withColumn("d", d).groupBy("symbol").agg(
        F.count_if(F.col("d") == 0).alias("repeated"), F.count_if(F.col("d") > step_ms).alias("broken_steps"), F.count_if((F.col("d") > 0) & (F.col("d") < step_ms)).alias("short_steps"),
        F.count_if("bad").alias("bad_prices"), F.count_if("still_open").alias("still_open"), F.count_distinct("t").alias("n_times"),
    )
    grid = b.select("t").distinct().agg(F.count("*").alias("grid"))
    return each.join(F.broadcast(grid)).select("symbol", "repeated", "broken_steps", "short_steps", "bad_prices", "still_open", (F.col("n_times") == F.col("grid")).alias("full_grid"))  # grid is one row


def universe(candidates: DataFrame, snapshots: DataFrame, cap: int, contract: str = "PERPETUAL", quote: str = "USDT") -> DataFrame:
    """Seed symbols with the first reason that excludes them; at most ``cap`` are included, in seed order."""
    j = candidates.join(snapshots, "symbol", "left")
    rule = lambda c, want: (F.col(c) != want) if c in snapshots.columns else F.lit(False)
    reason = (
        F.when(F.col("status").isNull(), "missing").when(rule("contract_type", contract), "contract").when(rule("quote_asset", quote), "quote")
        .when(F.col("status") != "TRADING", "status").when(F.col("listed_days") < F.col("min_days"), "listing_days")
    )
    j = j.withColumn("why", reason)
    ahead = F.sum(F.col("why").isNull().cast("long")).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    j = j.withColumn("why", F.when(F.col("why").isNull() & (ahead > cap), "cap").otherwise(F.col("why")))
    return j.select("symbol", F.col("why").isNull().alias("included"), F.coalesce("why", F.lit("included")).alias("reason"))
