"""Every catalogue query against its SQL on the smallest tables, and the driver contract."""

import math
from pathlib import Path

import duckdb
import pytest

from cohortloom.plans.catalog import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no driver tables here")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return 0.0 if v == 0 else float(f"{v:.9g}")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    if name not in ORACLE_SQL:
        assert df.count() >= 0
        return
    r = duck.execute(ORACLE_SQL[name])
    cols = [d[0] for d in r.description]
    order = sorted(cols)
    want = sorted(([plain(x[cols.index(c)]) for c in order] for x in r.fetchall()), key=str)
    got = sorted(([plain(x[c]) for c in order] for x in df.collect()), key=str)
    assert sorted(df.columns) == order and len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-5) for a, b in zip(g, w)), (g, w)


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
