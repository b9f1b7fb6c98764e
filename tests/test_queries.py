"""Every registered query of the reference's operators against its DuckDB equivalent."""

import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import campaign, feeds, research, trading  # noqa: F401 (register their queries)
from tidemark.plans.queries import ORACLES, QUERIES
from tidemark.sources import files


def once(f):
    """The shared panels of the research queries are made once a module, not once a query."""
    held = {}

    def run(spark, sf_dir, *args):
        key = (sf_dir, str(args))
        if key not in held:
            out = f(spark, sf_dir, *args)
            held[key] = out if isinstance(out, tuple) else files.staged(out)
        return held[key]

    return run


@pytest.fixture(scope="module", autouse=True)
def shared_panels():
    names = ("_pn", "_labelled", "_test_rows", "_positions", "_curve", "_two", "_trials")
    kept = {(m, n): getattr(m, n) for m, names in ((research, names), (campaign, ("_accounts",)), (trading, ("_labelled", "_positions", "_two"))) for n in names}
    for (m, n), f in kept.items():
        setattr(m, n, once(f))
    yield
    for (m, n), f in kept.items():
        setattr(m, n, f)


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in values]
    # By what is no float first: rows whose floats agree to four places keep their partners.
    text = lambda x: (x is None, "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x))
    return sorted(out, key=lambda r: (tuple(text(x) for x in r if not isinstance(x, float)), tuple(text(x) for x in r if isinstance(x, float))))


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        names = [x[0] for x in cur.description]
        want = rows(names, cur.fetchall())
        assert sorted(df.columns) == sorted(names) and len(got) == len(want)
        bad = [(a, b) for a, b in zip(got, want, strict=True) if any(not (x == y or isinstance(x, float) and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=2.1e-5)) for x, y in zip(a, b, strict=True))]
        assert not bad, bad[:3]
