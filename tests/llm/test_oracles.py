"""Corpus queries against their SQL in DuckDB, and the shape of those beyond SQL."""

import duckdb
import pytest

from slateql.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_matches_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, DIR)
    wanted = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(tuple(str(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(map(str, r)) for r in wanted.fetchall())


@pytest.mark.parametrize("name", ["op3_mixing", "op5_lines", "op8_toxicity", "op9_pii"])
def test_one_row_per_document(spark, duck, name):
    ids = sorted(r.doc_id for r in queries.QUERIES[name](spark, DIR).select("doc_id").collect())
    assert ids == [r[0] for r in duck.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]


def test_private_values_are_gone(spark, duck):
    texts = {r.doc_id: r.text for r in queries.QUERIES["op9_pii"](spark, DIR).collect()}
    rows = duck.execute(r"SELECT doc_id, unnest(regexp_extract_all(text, '\+1 \(\d{3}\) \d{3}-\d{4}|[\w.]+@[\w.]+\w')) FROM documents").fetchall()
    assert rows and all(value not in texts[i] for i, value in rows)


def test_every_operator_has_a_query():
    assert [n for n in queries.QUERIES if n.startswith("op")] == sorted((n for n in queries.QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len([n for n in queries.QUERIES if n.startswith("op")]) == 10 and "pipeline" in queries.QUERIES
