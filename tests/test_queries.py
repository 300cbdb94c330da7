"""Every registered query of the engine runs; those with SQL give DuckDB's rows."""

import pytest

from helixframe.queries import registered

from .conftest import comparable

QUERIES = registered()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    query, sql = QUERIES[name]
    got = query(spark, sf).toPandas()
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)
