"""The llm queries that SQL can express against it, on the smallest tables."""

import pytest

from callweave.llm import queries
from tests.test_queries import SF, duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):  # noqa: F811
    got = queries.queries()[name](spark, SF)
    order = sorted(got.columns)
    cur = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert order == sorted(names)
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == sorted(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in cur.fetchall())
