"""Every query of the library against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from callweave.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return str(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    order = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    if name not in plans.oracle_sql():
        assert rows
        return
    cur = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in cur.fetchall())
    assert order == sorted(names)
    assert rows == want
