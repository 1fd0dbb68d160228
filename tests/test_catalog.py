"""Every registered drawing query against its SQL, on the smallest tables, and the contract of the entry module."""

import math
import os

import pytest

from gridloom.plans import catalog

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("lineitem", "orders", "part", "customer", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES.get(t, kinds[c]) for c, t in df.dtypes} == kinds
    pick = ", ".join(f'"{c}"' for c in columns)
    expected = duck.sql(f"SELECT {pick} FROM ({catalog.ORACLE_SQL[name]}) q").fetchall()
    got = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted([tuple(plain(v) for v in r) for r in expected], key=repr)
    assert got


@needs_tables
def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


@needs_tables
@pytest.mark.parametrize("name", ["region_nms", "overlap_issues", "match_passes_a", "line_cluster_islands"])
def test_results_do_not_depend_on_partitioning(spark, name, monkeypatch):
    made = catalog.QUERIES[name](spark, SMALL)
    before = sorted(map(repr, made.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(repr, catalog.QUERIES[name](spark, SMALL).collect())) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
