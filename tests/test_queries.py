"""Every table-engine query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from slateql import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in queries.KEYS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return "~" if v is None else f"{v:.6f}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_matches_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, DIR)
    wanted = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    assert rows == sorted(tuple(map(plain, r)) for r in wanted.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
