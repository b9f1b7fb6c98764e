"""Statistics of return series, trades and groups."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURS_A_YEAR = 8760.0


def return_statistics(df: DataFrame, by: list[str], r: str, order: str, periods_a_year: float = HOURS_A_YEAR) -> DataFrame:
    """n, total, annualised return, volatility and Sharpe, max drawdown, Calmar and hit rate by group, which may be one
    long series: states of stretches of time are merged (windows.worst_drawdown)."""
    from .windows import worst_drawdown

    g = worst_drawdown(df, r, by, order)
    annual = F.expm1(F.col("log_sum") / F.col("n") * periods_a_year)
    s = F.col("deviation")
    return g.select(
        *by, "n", F.expm1("log_sum").alias("total_return"), annual.alias("annual_return"), (s * periods_a_year**0.5).alias("annual_volatility"),
        F.when(s > 1e-15, F.col("mean") / F.when(s > 1e-15, s) * periods_a_year**0.5).alias("sharpe"), "max_drawdown",
        F.when(F.col("max_drawdown") < 0, annual / F.abs("max_drawdown")).alias("calmar"), "hit_rate",
    )


def concentration(x: Column) -> Column:
    """Largest share of the summed magnitude; 0 where there is none."""
    return F.coalesce(F.try_divide(F.max(F.abs(x)), F.sum(F.abs(x))), F.lit(0.0))


def positive_concentration(x: Column) -> Column:
    """Largest share of the sum of what is above 0; 1 where nothing is."""
    up = F.when(x > 0, x)
    return F.coalesce(F.max(up) / F.sum(up), F.lit(1.0))


def exact_quantiles(df: DataFrame, by: list[str], x: str, at: dict[str, float], cells: int = 1024, ends: DataFrame | None = None) -> DataFrame:
    """Linearly interpolated quantiles of x by group, named as in ``at``, of groups of any size.

    Values are counted in equal cells between a group's extremes; the cells that hold the wanted ranks follow from the
    counts (at most ``cells`` rows a group), and only those cells' values are sorted. Rows without x are left out. ``ends``:
    the groups' __low, __high and __n, where they are known."""
    rows = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("__x"))
    if ends is None:
        ends = rows.groupBy(*by).agg(F.min("__x").alias("__low"), F.max("__x").alias("__high"), F.count("*").alias("__n"))
    same = reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by], F.lit(True))
    cell = F.when(F.col("__high") > F.col("__low"), F.floor((F.col("__x") - F.col("__low")) / (F.col("__high") - F.col("__low")) * cells)).otherwise(F.lit(0)).cast("int")
    placed = rows.alias("l").join(ends.alias("r"), same).select(*[F.col(f"l.{c}") for c in by], "__x", "__n", cell.alias("__cell"))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("__n") - 1) * q), F.ceil((F.col("__n") - 1) * q)) for q in at.values()])))
    counts = placed.groupBy(*by, "__cell").agg(F.count("*").alias("__c"), F.max("__n").alias("__n"))
    base = F.coalesce(F.sum("__c").over(Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__base", base).where(F.exists(wanted, lambda k: (k >= F.col("__base")) & (k < F.col("__base") + F.col("__c"))))
    near = placed.alias("l").join(counts.alias("r"), same & (F.col("l.__cell") == F.col("r.__cell"))).select(*[F.col(f"l.{c}") for c in by], "__x", F.col("r.__cell").alias("__cell"), F.col("r.__n").alias("__n"), "__base")
    near = near.withColumn("__k", F.col("__base") + F.row_number().over(Window.partitionBy(*by, "__cell").orderBy("__x")) - 1)
    value = lambda k: F.max(F.when(F.col("__k") == k, F.col("__x")))
    out = []
    for name, q in at.items():
        place = (F.col("__n") - 1) * q
        low, high = value(F.floor(place)), value(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return near.groupBy(*by).agg(*out)


def distribution(df: DataFrame, by: list[str], x: str) -> DataFrame:
    return exact_quantiles(df, by, x, {"minimum": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "maximum": 1.0})


def moments(df: DataFrame, by: list[str], x: str, least: int = 30) -> DataFrame:
    """Population skewness and kurtosis (3 for a normal), from ``least`` rows on."""
    ok = (F.count(x) >= least) & (F.var_pop(x) > 1e-24)
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.when(ok, F.skewness(x)).alias("skewness"), F.when(ok, F.kurtosis(x) + 3).alias("kurtosis"))


def grouping_metrics(trades: DataFrame, grains: list[str], pnl: str) -> DataFrame:
    """Trade metrics over all rows and by each grain: rows are repeated once for each grain and the whole, with the
    columns of the other grains null, as grouping sets do; grain is their grouping id."""
    one = lambda kept, number: F.struct(*[(F.col(g) if g == kept else F.lit(None).cast(trades.schema[g].dataType)).alias(g) for g in grains], F.lit(number).cast("long").alias("grain"))
    all_ = (1 << len(grains)) - 1
    sets = [one(None, all_)] + [one(g, all_ - (1 << (len(grains) - 1 - i))) for i, g in enumerate(grains)]
    by = [*grains, "grain"]
    from ..sources.files import staged

    one_table = staged(trades.select(*grains, pnl).where(F.col(pnl).isNotNull()))  # read for the metrics and twice for the quantiles
    t = one_table.select(F.explode(F.array(*sets)).alias("s"), F.col(pnl).cast("double").alias("__p")).select("s.*", "__p")
    p, win, loss = F.col("__p"), F.when(F.col("__p") > 0, F.col("__p")).otherwise(0.0), F.when(F.col("__p") < 0, -F.col("__p")).otherwise(0.0)
    g = t.groupBy(*by).agg(F.count("*").alias("n_trades"), F.sum(p).alias("total"), F.avg(p).alias("mean"), F.avg((p > 0).cast("double")).alias("win_rate"), F.try_divide(F.sum(win), F.sum(loss)).alias("profit_factor"), F.min("__p").alias("__low"), F.max("__p").alias("__high"))
    g = staged(g)  # a row a value of a grain
    q = exact_quantiles(t, by, "__p", {"median": 0.5, "p10": 0.1, "p90": 0.9}, ends=g.select(*by, "__low", "__high", F.col("n_trades").alias("__n")))
    out = g.alias("l").join(q.alias("r"), reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]))
    return out.select(*[F.col(f"l.{c}") for c in by], "n_trades", "total", "mean", "median", "p10", "p90", "win_rate", "profit_factor")


def regime_buckets(df: DataFrame, x: str) -> DataFrame:
    """low, middle or high by the thirds of x (linear quantiles), joined as one row."""
    q = exact_quantiles(df, [], x, {"__a": 1 / 3, "__b": 2 / 3})
    return df.join(F.broadcast(q)).withColumn("regime", F.when(F.col(x) <= F.col("__a"), "low").when(F.col(x) <= F.col("__b"), "middle").otherwise("high")).drop("__a", "__b")  # q is one row


def herfindahl(df: DataFrame, by: list[str], part: str, x: str) -> DataFrame:
    """Sum of squared shares of the parts, with the largest part and its share."""
    g = df.groupBy(*by, part).agg(F.sum(F.abs(x)).alias("__w"))
    total = F.sum("__w").over(Window.partitionBy(*by))
    g = g.withColumn("__s", F.try_divide("__w", total))
    return g.groupBy(*by).agg(F.sum(F.col("__s") * F.col("__s")).alias("hhi"), F.max_by(part, F.struct("__s", part)).alias("top_part"), F.max("__s").alias("top_share"))


def effective_count(pairs: DataFrame, corr: str = "correlation") -> DataFrame:
    """(sum of eigenvalues)^2 / sum of their squares = n^2 / sum of squared correlations, as the diagonal is 1."""
    return pairs.agg((F.pow(F.count_distinct("left_id"), F.lit(2.0)) / F.sum(F.pow(corr, F.lit(2.0)))).alias("effective_count"))


def decision_step(df: DataFrame, by: list[str], t: str) -> DataFrame:
    """Greatest common divisor of the positive steps of each series: of the distinct steps, which are few."""
    d = df.withColumn("__d", F.col(t) - F.lag(t).over(Window.partitionBy(*by).orderBy(t))).where("__d > 0").select(*by, "__d").distinct()
    gcd = lambda a, x: F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(F.greatest(a, x).alias("p"), F.least(a, x).alias("q")), lambda s, _: F.when(s.q == 0, s).otherwise(F.struct(s.q.alias("p"), F.pmod(s.p, F.when(s.q != 0, s.q)).alias("q"))), lambda s: s.p)
    return d.groupBy(*by).agg(F.aggregate(F.collect_set("__d"), F.lit(0).cast("long"), gcd).alias("step_ms"))


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values in the order of column names, each with its length or a mark for null."""
    parts = [F.when(F.col(c).isNull(), F.lit("n;")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"), F.lit(";"))) for c in sorted(columns)]
    return F.sha2(F.concat(*parts), 256)


def content_digest(df: DataFrame) -> DataFrame:
    """Digest of a table as a multiset of rows: its number of rows and, for 4 parts of the rows' SHA-256, their exact
    sums. Order and partitioning do not matter; repeated rows, nulls, column names and types do."""
    plain = df.select(*[F.to_json(F.struct(F.col(c))).alias(c) if f.dataType.typeName() in ("struct", "array", "map", "variant") else F.col(c) for c, f in zip(df.columns, df.schema.fields, strict=True)])
    h = plain.select(row_digest(plain.columns).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    names = F.lit(json.dumps(sorted(df.dtypes)))
    return h.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("|", names, *[F.coalesce(p, F.lit("0")) for p in parts]), 256).alias("digest"))


def ordered_digest(df: DataFrame, order: list[str], width: int, block: int = 1 << 16) -> DataFrame:
    """SHA-256 over the rows' digests in their order, by blocks: a replay's fingerprint. Rows are numbered (see
    windows.ranked for ``width``), each block of them is hashed in one task, and the blocks' hashes, 64 characters each, once more."""
    from .windows import ranked

    rows = ranked(df.withColumn("__h", row_digest(df.columns)), order, "__n", width)
    blocks = rows.groupBy(F.floor(F.col("__n") / block).alias("__b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__h"))), lambda x: x["__h"]), ""), 256).alias("h"), F.count("*").alias("n"))
    return blocks.agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))
