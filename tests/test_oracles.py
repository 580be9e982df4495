"""Every query of the library with SQL equals DuckDB's answer at the smallest size."""

import math

import duckdb
import pytest

from stowage import queries as core

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents pages benchmark events conversations labels".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_oracle(spark, duck, name):
    out = core.queries()[name](spark, DIR)
    want = duck.sql(core.oracle_sql()[name])
    assert sorted(out.columns) == sorted(want.columns)
    assert rows(out.columns, out.collect()) == rows(want.columns, want.fetchall())
