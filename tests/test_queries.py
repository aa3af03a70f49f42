"""Every registered query of the core runs; those with SQL give the same rows as DuckDB."""

import pytest

from compare import connection, same
from lumenfield.plans import load

QUERIES, SQL = load()
#: Columns that are null where nothing went wrong.
MAYBE_NULL = {"error"}


@pytest.fixture(scope="module")
def duck(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    equal, why = same(QUERIES[name](spark, data).toPandas(), duck, SQL[name])
    assert equal, why


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()  # every column is made; a count would prune them
    assert rows
    assert all(any(r[c] is not None for r in rows) for c in df.columns if c not in MAYBE_NULL)
