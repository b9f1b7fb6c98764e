"""Queries over events of which some are worth nothing, and some alike, against their DuckDB equivalents."""

import math
import os

import duckdb
import pytest

from tidemark.functions.columns import log, quotient
from tidemark.operators import features as fx
from tidemark.plans.queries import ORACLES, QUERIES

from .test_queries import SF, rows, shared_panels  # noqa: F401 (a fixture)

NAMES = [
    "attribution", "bar_contract", "blend_metrics", "bootstrap", "component_attribution", "curve_contract", "daily_positions", "deflated_sharpe", "features_clock_phase", "features_flow",
    "features_volatility", "labels", "metrics_by_fold", "metrics_by_month", "metrics_by_regime", "netted_portfolio", "pair_diagnostics", "point_in_time_audit", "policy_buffered_directional",
    "policy_buffered_long_flat", "policy_buffered_neutral", "policy_carry_regime", "policy_neutral_long_short", "policy_pair_spread", "policy_two_sleeves", "position_similarity", "rolling_sharpe", "stream_audit",
]


WORTHLESS = (7024, 7716, 7609)


@pytest.fixture(scope="module")
def priced(tmp_path_factory):
    """A folder with sf0.01's events, of which three are worth nothing and twenty are told again under other numbers. Zeros
    are followed by a price in their hour, and none is where a return of 5 or 15 bars begins, as on sf0.1."""
    path = tmp_path_factory.mktemp("zero")
    con = duckdb.connect()
    con.execute(f"""COPY (WITH x AS (SELECT * REPLACE (CASE WHEN event_id IN {WORTHLESS} THEN 0 ELSE value END AS value) FROM '{SF}/events.parquet')
      SELECT * FROM x UNION ALL SELECT * REPLACE (event_id + 40000 AS event_id) FROM x WHERE event_id % 4 = 2 AND event_id < 80) TO '{path}/events.parquet'""")
    return str(path)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_zero_prices(spark, priced, name):
    df = QUERIES[name](spark, priced)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{priced}/events.parquet'")
        cur = con.execute(ORACLES[name])
        names = [x[0] for x in cur.description]
        want = rows(names, cur.fetchall())
        assert len(got) == len(want)
        bad = [(a, b) for a, b in zip(got, want, strict=True) if any(not (x == y or isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=2.1e-5)) for x, y in zip(a, b, strict=True))]
        assert not bad, bad[:3]


def test_quotient_and_log(spark):
    inf = math.inf
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (3.0, 2.0), (None, 0.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in df.select(quotient(df.a, df.b)).collect()]
    assert got[:3] == [inf, -inf, -inf] and math.isnan(got[3]) and got[4:] == [1.5, None, None]
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,), (-1.0,), (None,)], "a double")
    assert [r[0] for r in df.select(log(df.a)).collect()] == [-inf, -inf, 0.0, None, None]


def test_rows_that_are_known(spark):
    df = spark.createDataFrame([(1, 1.0), (2, math.inf), (3, None)], "k int, x double")
    assert [r.k for r in fx.known_rows(df, ["x"]).collect()] == [1, 2] and [r.k for r in fx.finite_rows(df, ["x"]).collect()] == [1]
