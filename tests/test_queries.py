"""Every registered query of the library against its SQL twin in DuckDB, on the smallest tables."""

import duckdb
import pytest

from kbforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def comparable(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERY_NAMES))
def test_query(spark, sql, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    query = registry.oracle_sql().get(name)
    if query is None:
        assert got
        return
    found = sql.sql(query)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert comparable(got) == comparable(tuple(row[k] for k in at) for row in found.fetchall())
