"""Every registered query against its SQL at sf0.001: row count, column names and values."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return (0 if v is None else 1, str(v))
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return (2, "nan" if math.isnan(v) else f"{float(v):.6g}")
    return (3, str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    assert got, "no rows"
    if name in registry.ORACLE_SQL:
        cur = duck.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(names)
        assert rows_of(df.columns, got) == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLE_SQL) <= set(entry.oracle_sql())
