"""Every query with SQL against DuckDB, every other for a stable schema, over whole small tables."""

import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(DIR).is_dir(), reason="no test tables")


def norm(v):
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


def bag(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    r = con.execute(ORACLES[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == bag(columns, r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DIR)
    assert len(set(map(str.lower, df.columns))) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1


def test_found_queries_give_no_duplicates(spark):
    for name in [n for n in QUERIES if n.endswith("_found")]:
        df = QUERIES[name](spark, DIR)
        assert df.count() == df.distinct().count(), name
