"""Rolling, cross-sectional and segmented window operators. Frames are rows; t is epoch milliseconds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS, HOUR_MS, TINY, epoch_ms, only_finite


#: Columns of with_halo(): the part of a series that a row is in, and whether it is the part's own or a neighbour's.
PART, OWN = "__part", "__own"
#: Rows of a part, about.
PART_ROWS = 1 << 16


def by_symbol(df: DataFrame | None = None):
    """A symbol's rows in order of time; of a table cut by with_halo(), those of one part."""
    parts = [PART] if df is not None and PART in df.columns else []
    return Window.partitionBy("symbol", *parts).orderBy("t")


def same(left: str, right: str, columns: list[str]) -> Column:
    """Equality of columns of two aliased tables, nulls included."""
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns], F.lit(True))


def stretch(order: str, width: int) -> Column:
    """Number of the stretch of ``width`` that a number is in."""
    return F.floor(F.col(order) / F.lit(width))


def with_halo(df: DataFrame, back: int, ahead: int = 0, width: int = DAY_MS, rows: int | None = None, by: tuple[str, ...] = ("symbol",), t: str = "t") -> DataFrame:
    """Series cut into parts of about ``rows`` rows, each with the rows before and after it that windows of up to ``back``
    rows before and ``ahead`` rows after a row need; a long series is then many tasks' work (see own()).

    A part is a run of stretches of ``width`` of t, a number. Rows are counted by stretch first; from the counts follow
    the parts, and for each stretch the parts whose own rows reach into it: its own, and two on either side at most, as
    two neighbouring parts have more rows than a window (``rows`` is at least that). Windows must not look further than
    ``back`` and ``ahead`` in sum along a chain of columns made of each other."""
    rows = max(rows or PART_ROWS, back, ahead, 1)
    keys = [*by]
    counts = df.groupBy(*keys, stretch(t, width).alias("__s")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys).orderBy("__s")
    before = F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__before", before).withColumn(PART, F.floor(F.col("__before") / rows))
    parts = counts.groupBy(*keys, PART).agg(F.min("__before").alias("__start"))
    p = Window.partitionBy(*keys).orderBy(PART)
    near = {f"__{side}{k}": move(F.struct(PART, "__start"), k).over(p) for side, move in (("next", F.lead), ("last", F.lag)) for k in (1, 2)}
    placed = counts.alias("l").join(parts.withColumns(near).alias("r"), same("l", "r", [*keys, PART])).select("l.*", "r.__start", *near)
    after = F.col("__before") + F.col("__c")
    other = lambda number, ok: F.when(ok, F.struct(F.col(number).alias(PART), F.lit(False).alias(OWN)))
    goes = [F.struct(F.col(PART), F.lit(True).alias(OWN))]
    goes += [other(f"__next{k}.{PART}", F.col(f"__next{k}.__start") - after < back) for k in (1, 2)]
    # Rows between a part's end, which is where the part after it starts, and this stretch.
    goes += [other(f"__last{k}.{PART}", F.col("__before") - F.col(start) < ahead) for k, start in ((1, "__start"), (2, "__last1.__start"))]
    placed = placed.select(*keys, "__s", F.array_compact(F.array(*goes)).alias("__goes"))
    cut = df.withColumn("__s", stretch(t, width)).alias("l").join(placed.alias("r"), same("l", "r", [*keys, "__s"]))
    return cut.select(*[F.col(f"l.{c}") for c in df.columns], F.inline("__goes"))


def own(df: DataFrame) -> DataFrame:
    """A table cut by with_halo() with each row once again."""
    return df.where(OWN).drop(PART, OWN)


def by_time():
    return Window.partitionBy("t")


def _full(x: Column, w, n: int, value: Column) -> Column:
    return F.when(F.count(only_finite(x)).over(w) == n, value)


def trailing_sum(x: Column, n: int, shift: int = 0, by=None) -> Column:
    """Sum of n rows, ending ``shift`` rows ago; null unless all n are finite."""
    w = (by or by_symbol()).rowsBetween(-(n - 1 + shift), -shift)
    return _full(x, w, n, F.sum(x).over(w))


def rolling_mean(x: Column, n: int, by=None) -> Column:
    w = (by or by_symbol()).rowsBetween(-(n - 1), 0)
    return _full(x, w, n, F.avg(x).over(w))


def rolling_std(x: Column, n: int, by=None) -> Column:
    """Population deviation of a full window."""
    w = (by or by_symbol()).rowsBetween(-(n - 1), 0)
    return _full(x, w, n, F.stddev_pop(x).over(w))


def rolling_zscore(x: Column, n: int, by=None) -> Column:
    """The row itself included; 0 where the window does not vary."""
    m, s = rolling_mean(x, n, by), rolling_std(x, n, by)
    return F.when(s <= TINY, 0.0).otherwise((x - m) / F.when(s > TINY, s))


def realized_volatility(r: Column, n: int, by=None) -> Column:
    return F.sqrt(trailing_sum(r * r, n, 0, by))


def prior_extrema(high: Column, low: Column, n: int, by=None) -> tuple[Column, Column]:
    """Greatest and least of the n rows before this one; null for the first n."""
    w = (by or by_symbol()).rowsBetween(-n, -1)
    ready = F.row_number().over(by or by_symbol()) > n
    return F.when(ready, F.max(only_finite(high)).over(w)), F.when(ready, F.min(only_finite(low)).over(w))


def efficiency(df: DataFrame, price: str, n: int, name: str) -> DataFrame:
    """Net move over path length of n steps; 0 for a path that does not move."""
    w = by_symbol(df)
    df = df.withColumn("__d", F.abs(F.col(price) - F.lag(price).over(w)))
    path = trailing_sum(F.col("__d"), n, 0, w)
    net = F.abs(F.col(price) - F.lag(price, n).over(w))
    return df.withColumn(name, F.when(path <= TINY, 0.0).otherwise(net / F.when(path > TINY, path))).drop("__d")


def rolling_beta(y: Column, x: Column, n: int, by=None) -> Column:
    """Population covariance over variance of n rows; null where x does not vary or a value is missing."""
    w = (by or by_symbol()).rowsBetween(-(n - 1), 0)
    v = F.var_pop(x).over(w)
    return F.when((F.count(only_finite(x * y)).over(w) == n) & (v > 1e-18), F.covar_pop(y, x).over(w) / F.when(v > 1e-18, v))


def benchmark(df: DataFrame, r: str, first: str, second: str) -> DataFrame:
    """Mean of two leaders at each time; each leader is measured against the other."""
    a, b = (F.max(F.when(F.col("symbol") == s, F.col(r))).over(by_time()) for s in (first, second))
    return df.withColumn("bench", F.when(F.col("symbol") == first, b).when(F.col("symbol") == second, a).otherwise((a + b) / 2))


def cs_zscore(x: Column, by=None) -> Column:
    s = F.stddev_pop(x).over(by or by_time())
    return F.when(s <= TINY, 0.0).otherwise((x - F.avg(x).over(by or by_time())) / F.when(s > TINY, s))


def cs_rank(x: Column, tie: str = "symbol", by=None) -> Column:
    """Ordinal rank from 0; ties by symbol."""
    return F.row_number().over((by or by_time()).orderBy(x, tie)) - 1


def decile(x: Column, tie: str = "symbol", by=None) -> Column:
    """ceil(rank * 10 / n) in 1..10, not the buckets of ntile."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.ceil((cs_rank(x, tie, by) + 1) * 10 / F.count(F.lit(1)).over(by or by_time())))).cast("int")


def median_ratio(x: Column, power: float, by=None) -> Column:
    return F.pow(F.try_divide(x, F.percentile(x, 0.5).over(by or by_time())), F.lit(power))


def segments(df: DataFrame, step_ms: int = HOUR_MS) -> DataFrame:
    """Adds seg, which goes up by one wherever the symbol's times break; within a part of with_halo(), from its first row."""
    w = by_symbol(df)
    gap = (F.col("t") - F.lag("t").over(w) > step_ms).cast("int")
    return df.withColumn("__gap", F.coalesce(gap, F.lit(0))).withColumn("seg", F.sum("__gap").over(w)).drop("__gap")


def carried(df: DataFrame, x: str, name: str, by: list[str], t: str = "t", width: int = 30 * DAY_MS) -> DataFrame:
    """Adds the last x that is not null at or before each row, however long ago: within stretches of ``width``, and from
    stretch to stretch."""
    rows = df.withColumn("__b", stretch(t, width))
    inside = F.last(x, ignorenulls=True).over(Window.partitionBy(*by, "__b").orderBy(t).rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy(*by, "__b").agg(F.max_by(x, F.when(F.col(x).isNotNull(), F.col(t))).alias("__end"))
    w = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__before", F.last("__end", ignorenulls=True).over(w)).drop("__end")
    out = rows.withColumn("__in", inside).alias("l").join(ends.alias("r"), same("l", "r", [*by, "__b"]))
    return out.select(*[F.col(f"l.{c}") for c in df.columns], F.coalesce("__in", "__before").alias(name))


def segmented_sum(df: DataFrame, x: str, n: int, name: str, step_ms: int = HOUR_MS, width: int = 30 * DAY_MS, rows: int | None = None, number: bool = True) -> DataFrame:
    """Full-window sum within unbroken segments, then the last valid value carried on across breaks; seg (if ``number``)
    numbers the symbol's segments. Parts of a series (see with_halo) are summed apart, and segments and values handed on.

    The input is written once, as it is read for counts and for rows: calls that follow each other add up, where plans
    would multiply."""
    from ..sources.files import staged

    if PART in df.columns:
        raise ValueError("the series is cut already")
    cut = with_halo(staged(df), n, width=width, rows=rows)
    w = by_symbol(cut)
    cut = cut.withColumn("__gap", F.coalesce((F.col("t") - F.lag("t").over(w) > step_ms).cast("int"), F.lit(0))).withColumn("__seg", F.sum("__gap").over(w))
    inner = Window.partitionBy("symbol", PART, "__seg").orderBy("t")
    # Windows of a part's first rows see as many rows of its halo as they need, and the halo's own breaks.
    one = cut.withColumn("__s", trailing_sum(F.col(x), n, 0, inner)).where(OWN).drop(OWN, "__seg")
    if not number:
        return carried(one.drop(PART, "__gap"), "__s", name, ["symbol"], "t", width).drop("__s")
    breaks = one.groupBy("symbol", PART).agg(F.sum("__gap").alias("__breaks"))
    before = F.sum("__breaks").over(Window.partitionBy("symbol").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    breaks = breaks.select("symbol", PART, F.coalesce(before, F.lit(0)).alias("__first"))
    running = F.sum("__gap").over(Window.partitionBy("symbol", PART).orderBy("t"))
    one = one.withColumn("seg", running).alias("l").join(breaks.alias("r"), same("l", "r", ["symbol", PART]))
    one = one.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("seg") + F.col("__first")).alias("seg"), "__s")
    return carried(one, "__s", name, ["symbol"], "t", width).drop("__s")


#: Rows of a compounded series are scanned within stretches of so many milliseconds; a stretch hands on one row.
SCAN_MS = 30 * DAY_MS


def _scanned(df: DataFrame, r: str, by: list[str], order: str, width: int) -> DataFrame:
    """Adds __b, the stretch, and within it the running sum of logs __log and its running maximum __top."""
    number = F.col(order) if df.schema[order].dataType.typeName() not in ("date", "timestamp", "timestamp_ntz") else epoch_ms(F.col(order))
    w = Window.partitionBy(*by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__b", F.floor(number / F.lit(width))).withColumn("__log", F.sum(F.log1p(r)).over(w))
    return df.withColumn("__top", F.max("__log").over(w))


def _handed_on(states: DataFrame, by: list[str]) -> DataFrame:
    """Per stretch, what the stretches before it come to: sum of logs __base and the greatest running sum __peak. states:
    by, __b, __sum, __high. The sum is a running one over stretches, so a chain of stretches is as one long scan."""
    w = Window.partitionBy(*by).orderBy("__b")
    all_before = w.rowsBetween(Window.unboundedPreceding, -1)
    base = states.withColumn("__base", F.coalesce(F.sum("__sum").over(all_before), F.lit(0.0)))
    return base.withColumn("__peak", F.max(F.col("__base") + F.col("__high")).over(all_before))


def drawdown(df: DataFrame, r: str, by: list[str], order: str, width: int = SCAN_MS) -> DataFrame:
    """equity (compounded r) and drawdown against its running peak; the starting capital is not a peak. Rows without r
    have the equity before them, null at a series' start.

    A scan in two levels: sums of logs and peaks within stretches of ``width`` of ``order``, and over the stretches'
    states. So one long curve, grouped by nothing, is still the work of many tasks."""
    rows = _scanned(df, r, by, order, width)
    states = rows.groupBy(*by, "__b").agg(F.sum(F.log1p(r)).alias("__sum"), F.max("__log").alias("__high"))
    out = rows.alias("l").join(_handed_on(states, by).alias("r"), same("l", "r", [*by, "__b"]))
    started = F.col("__log").isNotNull() | F.col("__peak").isNotNull()
    equity = F.when(started, F.exp(F.col("__base") + F.coalesce("__log", F.lit(0.0))))
    peak = F.exp(F.greatest("__peak", F.col("__base") + F.col("__top")))
    return out.select(*[F.col(f"l.{c}") for c in df.columns], equity.alias("equity"), (equity / peak - 1).alias("drawdown"))


def worst_drawdown(df: DataFrame, r: str, by: list[str], order: str, width: int = SCAN_MS) -> DataFrame:
    """One row a group: n, log_sum and max_drawdown of the compounded rows that have r, and what else ``merge`` sums up.

    No row is joined with what came before it: a stretch's state (sum of logs, greatest and least running sum, least
    ratio to a peak within) is all that the next level needs, as the least ratio of a chain of stretches is the least of
    those within and of each least sum against the peak of the stretches before."""
    rows = _scanned(df.where(F.col(r).isNotNull()), r, by, order, width)
    x = F.col(r)
    states = rows.groupBy(*by, "__b").agg(
        F.sum(F.log1p(x)).alias("__sum"), F.max("__log").alias("__high"), F.min("__log").alias("__low"), F.min(F.col("__log") - F.col("__top")).alias("__within"),
        F.count("*").alias("__n"), F.sum(x).alias("__x"), F.count_if(x > 0).alias("__up"), F.var_pop(x).alias("__var"), F.avg(x).alias("__mean"),
    )
    return merged_states(states, by)


def merged_states(states: DataFrame, by: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """One row a group from the states of its stretches: n, log_sum, max_drawdown, mean, deviation, hit_rate and ``sums``."""
    chained = _handed_on(states, by)
    least = F.least(F.col("__within"), F.col("__base") + F.col("__low") - F.col("__peak"))
    n, mean = F.sum("__n"), F.sum("__x") / F.sum("__n")
    # Squared deviations of all rows: those within stretches, and those of the stretches' means, whose mean is taken
    # from its own window so that no large squares are subtracted.
    total = F.sum("__x").over(Window.partitionBy(*by)) / F.sum("__n").over(Window.partitionBy(*by))
    chained = chained.withColumn("__dev", F.col("__n") * (F.col("__var") + F.pow(F.col("__mean") - total, F.lit(2.0))))
    return chained.groupBy(*by).agg(
        n.alias("n"), F.sum("__sum").alias("log_sum"), F.expm1(F.min(least)).alias("max_drawdown"), mean.alias("mean"),
        F.when(n > 1, F.sqrt(F.sum("__dev") / (n - 1))).alias("deviation"), (F.sum("__up") / n).alias("hit_rate"), *[F.sum(c).alias(c) for c in sums],
    )


def drawdown_episodes(df: DataFrame, by: list[str], order: str, top: int = 5) -> DataFrame:
    """The deepest episodes: start, trough, last time under water and recovery (null, and ongoing, if there is none),
    depth, rows, and milliseconds from start to trough and to recovery or the last row; islands between peaks."""
    w = Window.partitionBy(*by).orderBy(order)
    df = df.withColumn("__peak", (F.col("drawdown") >= 0).cast("int")).withColumn("__island", F.sum("__peak").over(w)).withColumn("__next", F.lead(order).over(w))
    e = df.where("drawdown < 0").groupBy(*by, "__island").agg(
        F.min(order).alias("start"), F.min_by(order, F.struct("drawdown", order)).alias("trough"), F.max(order).alias("end"),
        F.max_by("__next", order).alias("recovery"), F.min("drawdown").alias("depth"), F.count("*").alias("n_rows"),
    )
    e = e.withColumns({"ongoing": F.col("recovery").isNull(), "to_trough": F.col("trough") - F.col("start"), "duration": F.coalesce("recovery", "end") - F.col("start")})
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("depth", "start"))
    return e.withColumn("rank", rank).where(F.col("rank") <= top).drop("__island")


def ranked(df: DataFrame, order: list[str], name: str, width: int) -> DataFrame:
    """Numbers all rows from 0 in the order given, whose first column is a number, without sorting them in one task:
    rows are numbered within stretches of ``width`` of that column, and a running count over the stretches is added."""
    b = F.floor(F.col(order[0]) / width)
    counts = df.groupBy(b.alias("__b")).agg(F.count("*").alias("__c"))
    before = counts.select("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    rows = df.withColumn("__b", b).withColumn("__i", F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1)
    out = rows.alias("l").join(before.alias("r"), F.col("l.__b").eqNullSafe(F.col("r.__b")))
    return out.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("__i") + F.col("__base")).alias(name))


def previous(df: DataFrame, by: list[str], order: list[str], values: list[str], width: int) -> DataFrame:
    """Adds prev, the struct of ``values`` of the row before in each group; null for the first.

    Groups may be few and long: rows meet within stretches of ``width`` of the first order column, a number, and each
    stretch is handed the last row of the one before it, so no task sorts a whole group."""
    b = F.floor(F.col(order[0]) / width)
    rows = df.withColumn("__b", b)
    inside = F.lag(F.struct(*values)).over(Window.partitionBy(*by, "__b").orderBy(*order))
    last = rows.groupBy(*by, "__b").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__last"))
    carried = last.withColumn("__carry", F.lag("__last").over(Window.partitionBy(*by).orderBy("__b"))).drop("__last")
    rows = rows.withColumn("__in", inside)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "__b")]
    out = rows.alias("l").join(carried.alias("r"), reduce(Column.__and__, same))
    return out.select(*[F.col(f"l.{c}") for c in df.columns], F.coalesce("__in", "__carry").alias("prev"))


def sequence_gaps(df: DataFrame, by: list[str], ident: str, width: int = 1 << 20) -> DataFrame:
    """Ids missing between distinct neighbours."""
    d = previous(df.select(*by, ident).distinct(), by, [ident], [ident], width)
    lost = F.greatest(F.col(ident) - F.col(f"prev.{ident}") - 1, F.lit(0))
    return d.withColumn("lost", lost).groupBy(*by).agg(F.coalesce(F.sum("lost"), F.lit(0)).cast("long").alias("missing_ids"))


def regressions(df: DataFrame, by: list[str], ident: str, arrival: list[str], width: int = DAY_MS) -> DataFrame:
    """Rows whose id is not above that of the row that arrived before; the first arrival column is a number."""
    d = previous(df.select(*dict.fromkeys([*by, ident, *arrival])), by, arrival, [ident], width)
    return d.groupBy(*by).agg(F.count_if(F.coalesce(F.col(ident) <= F.col(f"prev.{ident}"), F.lit(False))).alias("regressions"))
