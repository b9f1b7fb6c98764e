"""Correlations of all pairs of series in one pass, and the spectrum of their matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS
from .windows import same


def masked_correlations(df: DataFrame, by: str, t: str, x: str, mask: str | None = None, groups: tuple[str, ...] = (), least: int = 30, width: int = 30 * DAY_MS) -> DataFrame:
    """Pearson correlation of every ordered pair of series over the times at which both have x and both masks hold, by the
    columns ``groups``: left_id, right_id, n, correlation; null under ``least`` common times or without spread.

    Rows go to stretches of ``width`` of time once, and each stretch is a matrix of times by series: the products of it
    and its mask are the counts, sums, squares and cross products of all pairs. These are summed over stretches, so rows
    never meet rows, and a stretch hands on a row a pair. Values are taken from their series' mean, so that little is lost
    in the squares. A series has one row a time; of more the last is taken."""
    keep = F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))
    rows = df.where(keep & F.col(mask) if mask else keep).select(*groups, F.col(by).alias("__id"), F.col(t).alias("__t"), F.col(x).cast("double").alias("__x"))
    means = rows.groupBy(*groups, "__id").agg(F.avg("__x").alias("__m"))
    rows = rows.alias("l").join(means.alias("r"), same("l", "r", [*groups, "__id"])).select(*[F.col(f"l.{c}") for c in (*groups, "__id", "__t")], (F.col("__x") - F.col("__m")).alias("__x"))
    rows = rows.withColumn("__b", F.floor(F.col("__t") / F.lit(width)))
    names = ["n", "sl", "sr", "ql", "qr", "p"]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ids, column = np.unique(part["__id"].to_numpy(), return_inverse=True)
        _, row = np.unique(part["__t"].to_numpy(), return_inverse=True)
        v = np.zeros((row.max() + 1, len(ids)))
        has = np.zeros_like(v)
        v[row, column], has[row, column] = part["__x"].to_numpy(), 1.0
        n, s, q, p = has.T @ has, v.T @ has, (v * v).T @ has, v.T @ v
        i, j = np.nonzero(n)
        out = {g: k for g, k in zip(groups, key, strict=False)} | {"left_id": ids[i], "right_id": ids[j]}
        return pd.DataFrame(out | dict(zip(names, (n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]), strict=True)))

    kind = df.schema[by].dataType.simpleString()
    head = "".join(f"{g} {df.schema[g].dataType.simpleString()}, " for g in groups)
    parts = rows.groupBy(*groups, "__b").applyInPandas(run, f"{head}left_id {kind}, right_id {kind}, " + ", ".join(f"{c} double" for c in names))
    g = parts.groupBy(*groups, "left_id", "right_id").agg(*[F.sum(c).alias(c) for c in names])
    vl, vr = ((F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col("n")) / F.col("n") for k in "lr")
    c = (F.col("p") - F.col("sl") * F.col("sr") / F.col("n")) / F.col("n")
    ok = (F.col("n") >= least) & (F.sqrt(F.greatest(vl, F.lit(0.0))) > 1e-18) & (F.sqrt(F.greatest(vr, F.lit(0.0))) > 1e-18)
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c / F.sqrt(F.when(ok, vl * vr))))
    return g.select(*groups, "left_id", "right_id", F.col("n").cast("long").alias("n"), F.when(ok, bounded).alias("correlation"))


def spectrum(pairs: DataFrame, groups: list[str], value: str = "correlation", tolerance: float | None = None) -> DataFrame:
    """Per group of ordered pairs: the series n, the eigenvalues of their symmetric matrix, largest first, its rank (those
    above ``tolerance`` times the largest magnitude; the series' number times the float step, if none is given) and
    effective_count, (sum of eigenvalues)^2 / sum of their squares. A pair that is missing or null leaves no eigenvalues.

    A group is a matrix of its series, as many as strategies or symbols that one compares, in one task."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ids, place = np.unique(np.concatenate([part["left_id"], part["right_id"]]), return_inverse=True)
        m = np.full((len(ids), len(ids)), np.nan)
        m[place[: len(part)], place[len(part) :]] = part[value].to_numpy(float)
        whole = bool(np.isfinite(m).all())
        e = np.linalg.eigvalsh((m + m.T) / 2)[::-1] if whole else np.zeros(0)
        top = np.abs(e).max(initial=0.0)
        rank = int((np.abs(e) > top * (tolerance if tolerance is not None else len(ids) * np.finfo(float).eps)).sum()) if whole else None
        count = float(e.sum() ** 2 / (e**2).sum()) if whole and top > 0 else None
        out = dict(zip(groups, key, strict=False)) | {"n": len(ids), "eigenvalues": [e.tolist()], "rank": rank, "effective_count": count}
        return pd.DataFrame(out, index=[0])

    head = "".join(f"{g} {pairs.schema[g].dataType.simpleString()}, " for g in groups)
    return pairs.select(*groups, "left_id", "right_id", value).groupBy(*groups).applyInPandas(run, f"{head}n int, eigenvalues array<double>, rank int, effective_count double")
