"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for name in os.listdir(DATA):
        made.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return made


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    norm = lambda x: round(float(x), 6) if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f" else x
    return sorted(repr([norm(v) if not hasattr(v, "item") else norm(v.item()) for v in row]) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    ours = catalog.queries()[name](spark, DATA).toPandas()
    theirs = duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = _rows(ours), _rows(theirs)
    assert len(a) == len(b)
    assert a == b


@pytest.mark.parametrize("name", sorted({*catalog.queries()} - {*SQL}))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).limit(1).count() == 1
