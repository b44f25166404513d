"""Every catalogue query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from gridloom.plans import catalog, portfolio, problems, traces, workbooks  # noqa: F401  portfolio and traces add to the catalogue

DATA = os.environ.get("GRIDLOOM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
QUERIES, ORACLES = problems.QUERIES | catalog.QUERIES | workbooks.QUERIES, problems.ORACLES | catalog.ORACLES | workbooks.ORACLES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    res = db.execute(ORACLES[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr(tuple(plain(r[cols.index(c)]) for c in sorted(cols))) for r in res.fetchall())
    assert got == want
