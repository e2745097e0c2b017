"""Registered queries at the smallest scale: they run, and equal the DuckDB SQL of the same name."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from grainmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else (str(v) if isinstance(v, (bool, str)) else round(float(v), 6) + 0.0)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cur.fetchall(), names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["k", "map"]
