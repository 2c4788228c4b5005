"""Every registered catalog query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from stratalog.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    cur = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    want = [tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(got) == sorted(want)
