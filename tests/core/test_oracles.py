"""Every core query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from panelweave.plans import QUERIES_OF

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = QUERIES_OF()


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return str(v.date()) if v.time() == datetime.time() else str(v)
    return v if isinstance(v, (int, bool, str, type(None))) else str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted([tuple(cell(r[c]) for c in names) for r in table.to_pylist()], key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = rows(QUERIES[name](spark, SF).toArrow())
    if name in ORACLES:
        want = rows(con.execute(ORACLES[name]).to_arrow_table())
        assert got[0] == want[0] and len(got[1]) == len(want[1])
        for a, b in zip(got[1], want[1], strict=True):
            assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1e-4 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)
