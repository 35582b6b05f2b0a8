"""Every registered query of this package against its SQL, on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from rostra.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: Run both at a larger size too (slower): ROSTRA_SF=/root/testdata/sf0.01.
SF = os.environ.get("ROSTRA_SF", SF)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float | Decimal):
        return None if math.isnan(v) else round(float(v), 6)
    return v if v is None or isinstance(v, bool | int | str) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr([plain(v) for v in r]) for r in cursor.fetchall())
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0
