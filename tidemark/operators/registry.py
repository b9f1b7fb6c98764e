"""Relational queries over tables of experiments, runs, files and features. Small tables, plain DataFrame code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def users_of(features: DataFrame, links: DataFrame, experiments: DataFrame, campaigns: DataFrame, feature: str) -> DataFrame:
    """Distinct campaigns one of whose experiments uses the feature. features: feature_id, name; links: feature_id,
    experiment_id; experiments: experiment_id, campaign_id; campaigns: campaign_id, and more."""
    one = features.where(F.col("name") == feature).join(links, "feature_id").join(experiments, "experiment_id")
    return campaigns.join(one.select("campaign_id"), "campaign_id", "left_semi").distinct()


def uses(experiments: DataFrame, links: DataFrame, features: DataFrame, feature: str) -> DataFrame:
    """Experiments with ``used``: whether they use the feature."""
    of = links.join(features.where(F.col("name") == feature), "feature_id", "left_semi").select("experiment_id").distinct().withColumn("__u", F.lit(True))
    return experiments.join(of, "experiment_id", "left").withColumn("used", F.coalesce("__u", F.lit(False))).drop("__u")


def latest_success(runs: DataFrame, success: str = "SUCCEEDED") -> DataFrame:
    """The successful run of the greatest attempt of each experiment; runs: experiment_id, run_id, attempt, status."""
    return runs.where(F.col("status") == success).groupBy("experiment_id").agg(F.max("attempt").alias("attempt"), F.max_by("run_id", F.struct("attempt", "run_id")).alias("run_id"))


def stale(runs: DataFrame, cutoff: int, active: tuple[str, ...] = ("RUNNING", "QUEUED"), ended: str = "STALE") -> DataFrame:
    """Active runs whose last sign of life (heartbeat, else start, else creation) is before the cutoff, marked ended."""
    dead = F.col("status").isin(*active) & (F.coalesce("heartbeat", "started", "created") < cutoff)
    return runs.withColumn("was_stale", F.coalesce(dead, F.lit(False))).withColumn("status", F.when(F.col("was_stale"), ended).otherwise(F.col("status")))


def listed(files: DataFrame, any_of: dict[str, list] | None = None, start: int | None = None, end: int | None = None, low: str = "start_t", high: str = "end_t", order: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose columns are among the given values and whose interval overlaps [start, end], sorted. What is not
    given does not filter; an empty list of values matches nothing."""
    rules: list[Column] = [F.col(c).isin(v) if v else F.lit(False) for c, v in (any_of or {}).items() if v is not None]
    rules += [F.col(high) >= start] if start is not None else []
    rules += [F.col(low) <= end] if end is not None else []
    out = files.where(reduce(Column.__and__, rules)) if rules else files
    return out.orderBy(*order) if order else out


def bad_transitions(changes: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Changes (from_status, to_status) that the list of allowed ones does not have."""
    ok = changes.sparkSession.createDataFrame(allowed, "from_status string, to_status string")
    return changes.join(F.broadcast(ok), ["from_status", "to_status"], "left_anti")  # a declared list


def backfill_targets(symbols: DataFrame, first: str, last: str, cutoff: str, have: DataFrame | None = None) -> DataFrame:
    """Symbols times the days from first to last, none after the cutoff day, less those there already (symbol, day)."""
    day = F.explode(F.sequence(F.lit(first).cast("date"), F.least(F.lit(last).cast("date"), F.lit(cutoff).cast("date"))))
    if min(last, cutoff) < first:
        return symbols.select("symbol", F.lit(None).cast("date").alias("day")).where("false")
    out = symbols.select("symbol").distinct().withColumn("day", day)
    return out.join(have.select("symbol", "day"), ["symbol", "day"], "left_anti") if have is not None else out


def trial_plan(grid: DataFrame, valid: Column, order: list[str]) -> DataFrame:
    """Valid combinations numbered in order of their identifier, with the number of combinations left out."""
    ident = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in order]), 256)
    marked = grid.withColumns({"trial_id": ident, "__ok": F.coalesce(valid, F.lit(False))})
    rejected = F.sum((~F.col("__ok")).cast("long")).over(Window.partitionBy())
    out = marked.withColumn("rejected", rejected).where("__ok")  # a grid is a declared product of lists
    return out.withColumn("ordinal", F.row_number().over(Window.orderBy("trial_id"))).drop("__ok")


def catalogue(experiments: DataFrame, runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row an experiment: latest successful run, metrics, Calmar, and its peers of one compatibility hash; by
    Sharpe, those without last. metrics: run_id, name, value."""
    wide = metrics.groupBy("run_id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("sharpe", "annual_return", "max_drawdown")])
    j = experiments.join(latest_success(runs), "experiment_id", "left").join(wide, "run_id", "left")
    calmar = F.when(F.col("max_drawdown") < 0, F.col("annual_return") / F.abs("max_drawdown"))
    peers = experiments.groupBy("compatibility").agg(F.count("*").alias("peers"))
    return j.withColumn("calmar", calmar).join(peers, "compatibility").orderBy(F.desc_nulls_last("sharpe"), "experiment_id")


def manifest_files(manifest: DataFrame, dataset: str, statuses: tuple[str, ...], start: int, end: int) -> list[str]:
    """Paths to scan, from a manifest (path, dataset, status, start_t, end_t): files pruned before any is opened."""
    rows = listed(manifest, {"dataset": [dataset], "status": list(statuses)}, start, end).select("path").distinct()
    return sorted(r.path for r in rows.collect())  # a row a file of one dataset's interval
