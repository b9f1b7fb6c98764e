"""Metrics of a compounded series at several grains in one pass over its rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import SCAN_MS, merged_states


def metrics_by_grains(df: DataFrame, grains: dict[str, Column], r: str, order: list[str], sums: tuple[str, ...] = (), periods_a_year: float = 8760.0, width: int = SCAN_MS) -> DataFrame:
    """grain, value, n, total and annual return, mean, deviation, Sharpe, max drawdown and hit rate of r compounded in
    ``order`` (its first column a number), and sums of further columns: a row for each value of each grain, nulls being
    a value. Rows without r are left out.

    Rows are shuffled once, by stretch of time. A stretch's task makes the state of each value of each grain (sum of logs,
    greatest and least running sum, least ratio to a peak, count, mean and squared deviations), and states are merged in
    the order of stretches, which drawdowns need; so the number of grains adds states, not passes over the rows."""
    named = {f"__g{i}": c.cast("string") for i, c in enumerate(grains.values())}
    rows = df.where(F.col(r).isNotNull()).select(*[c.alias(n) for n, c in named.items()], *dict.fromkeys([*order, r, *sums]))
    rows = rows.withColumn("__b", F.floor(F.col(order[0]) / F.lit(width)))
    names, columns = [*grains], [*named]  # no columns of Spark's in what goes to tasks
    state = ["__sum", "__high", "__low", "__within", "__n", "__x", "__up", "__var", "__mean"]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        x, more = part[r].to_numpy(float), part[list(sums)].to_numpy(float)
        logs, out = np.log1p(x), []
        for grain, name in zip(names, columns, strict=True):
            code, values = pd.factorize(part[name], use_na_sentinel=False)
            at = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code, minlength=len(values)))
            for value, a, z in zip(values, np.concatenate([[0], ends[:-1]]), ends, strict=True):
                mine = at[a:z]
                run_, v = np.cumsum(logs[mine]), x[mine]
                within = (run_ - np.maximum.accumulate(run_)).min()
                out.append((grain, None if pd.isna(value) else value, key[0], run_[-1], run_.max(), run_.min(), within, len(v), v.sum(), int((v > 0).sum()), v.var(), v.mean(), *np.nansum(more[mine], axis=0)))
        return pd.DataFrame(out, columns=["grain", "value", "__b", *state, *sums])

    kinds = ", ".join(f"{c} {'long' if c in ('__n', '__up') else 'double'}" for c in (*state, *sums))
    states = rows.groupBy("__b").applyInPandas(run, f"grain string, value string, __b long, {kinds}")
    g = merged_states(states, ["grain", "value"], sums)
    s = F.col("deviation")
    return g.withColumns({
        "total_return": F.expm1("log_sum"), "annual_return": F.expm1(F.col("log_sum") / F.col("n") * periods_a_year),
        "sharpe": F.when(s > 1e-15, F.col("mean") / F.when(s > 1e-15, s) * periods_a_year**0.5),
    }).drop("log_sum")
