"""The table engine's queries over the test tables, with their DuckDB SQL.

Read queries run over external tables, DML over managed copies in a root of
their own in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateql.engine import Engine
from slateql.errors import ExecutionError
from slateql.operators.keyvalue import KeyValueTable
from slateql.sources.external import External
from slateql.sources.shared import new_folder

QUERIES = {}
ORACLE_SQL = {}

KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": None,
    "events": "event_id",
    "documents": "doc_id",
    "labels": "doc_id",
}


def _root(spark: SparkSession) -> str:
    """A root that the query's DataFrame reads; ``remove_folders`` clears it away afterwards."""
    return new_folder(spark, "engine")


def reader(spark: SparkSession, sf_dir: str, *tables: str, strict: bool = True) -> Engine:
    engine = Engine(spark, _root(spark), strict)
    for t in tables:
        engine.register(t, f"{sf_dir}/{t}.parquet", KEYS[t])
    return engine


def managed(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> Engine:
    """A managed copy of a table's integer, text and boolean columns."""
    engine = Engine(spark, _root(spark))
    engine.create_from(table, External.open(spark, table, f"{sf_dir}/{table}.parquet").read(spark).select(KEYS[table], *columns), KEYS[table])
    return engine


def _read(name: str, table: str, sql: str, oracle: str | None = None, strict: bool = True) -> None:
    QUERIES[name] = lambda spark, sf_dir: reader(spark, sf_dir, table, strict=strict).sql(sql)
    ORACLE_SQL[name] = oracle or sql


FLAGSHIP = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 10 OR o_orderkey = 3"

# Scans and projection: S1, P1-P3
_read("scan_star", "nation", "SELECT * FROM nation")
_read("scan_events", "events", "SELECT * FROM events")
_read("project", "customer", "SELECT c_name, c_nationkey FROM customer")
_read("project_reordered", "supplier", "SELECT s_nationkey, s_suppkey FROM supplier")
_read("case_insensitive_cols", "region", "SELECT R_NAME FROM region", "SELECT r_name FROM region")
_read("scan_without_key", "lineitem", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
# Integer predicates: F1-F6
_read("int_eq", "orders", "SELECT * FROM orders WHERE o_custkey = 7")
_read("int_ne", "part", "SELECT p_partkey, p_size FROM part WHERE p_size != 10")
_read("int_lt", "part", "SELECT p_partkey, p_size FROM part WHERE p_size < 10")
_read("int_gt", "part", "SELECT p_partkey, p_size FROM part WHERE p_size > 40")
_read("int_le", "part", "SELECT p_partkey, p_size FROM part WHERE p_size <= 10")
_read("int_ge", "part", "SELECT p_partkey, p_size FROM part WHERE p_size >= 40")
_read("int_range", "part", "SELECT p_partkey, p_name FROM part WHERE p_size >= 10 AND p_size < 20")
_read("int_vs_string", "part", "SELECT p_partkey FROM part WHERE p_size = '10'", "SELECT p_partkey FROM part WHERE p_size = 10")
_read("int_signed_string", "part", "SELECT p_partkey FROM part WHERE p_size > '-5'", "SELECT p_partkey FROM part WHERE p_size > -5")
_read("int_bad_literal", "part", "SELECT p_partkey FROM part WHERE p_size != abc", "SELECT p_partkey FROM part WHERE false")
_read("int_overflow_literal", "part", "SELECT p_partkey FROM part WHERE p_size < 99999999999999999999", "SELECT p_partkey FROM part WHERE false")
# Text predicates: F7-F12
_read("text_eq", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
_read("text_ne", "events", "SELECT event_id, event_type FROM events WHERE event_type != 'click'")
_read("text_lt", "events", "SELECT event_id, event_type FROM events WHERE event_type < 'error'")
_read("text_gt", "events", "SELECT event_id, event_type FROM events WHERE event_type > 'error'")
_read("text_le", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment <= 'FURNITURE'")
_read("text_ge", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment >= 'FURNITURE'")
_read("text_vs_number", "customer", "SELECT c_custkey FROM customer WHERE c_name > 5", "SELECT c_custkey FROM customer WHERE c_name > '5'")
_read("text_vs_ident", "events", "SELECT event_id FROM events WHERE event_type = click", "SELECT event_id FROM events WHERE event_type = 'click'")
# Logic: F19-F22
_read("and_or_precedence", "orders", FLAGSHIP)
_read("unknown_col_false", "region", "SELECT * FROM region WHERE ghost = 1", "SELECT * FROM region WHERE false")
_read("unknown_col_or", "region", "SELECT * FROM region WHERE ghost = 1 OR r_regionkey = 1", "SELECT * FROM region WHERE r_regionkey = 1")
_read("double_gt", "customer", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
_read("documents_by_source", "documents", "SELECT * FROM documents WHERE source = src0 AND lang = de", "SELECT * FROM documents WHERE source = 'src0' AND lang = 'de'")
# G1: what follows a statement is ignored on request
_read("trailing_tokens", "nation", "SELECT n_name FROM nation ORDER BY n_name LIMIT 3", "SELECT n_name FROM nation", strict=False)


def _query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _flags(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark, _root(spark))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("toxic") == 1).alias("is_toxic"))
    engine.create_from("flags", labels, "doc_id")
    return engine


def _bool(name: str, where: str, oracle: str) -> None:
    """F13-F18."""
    QUERIES[name] = lambda spark, sf_dir: _flags(spark, sf_dir).sql(f"SELECT * FROM flags WHERE is_toxic {where}")
    ORACLE_SQL[name] = f"SELECT doc_id, toxic = 1 AS is_toxic FROM labels WHERE {oracle}"


_bool("bool_eq", "= TRUE", "toxic = 1")
_bool("bool_ne", "!= true", "toxic != 1")
_bool("bool_lt", "< true", "toxic != 1")
_bool("bool_gt", "> false", "toxic = 1")
_bool("bool_le", "<= 'true'", "true")
_bool("bool_ge", ">= true", "toxic = 1")
_bool("bool_vs_number", "> 1", "true")
_bool("bool_vs_word", "= maybe", "false")


@_query("SELECT * FROM (SELECT o_orderkey AS key, o_custkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 200)")
def kv_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2."""
    rows = _order_fields(spark, sf_dir).range_scan(100, 200)
    return rows.select(F.col("key").cast("bigint").alias("key"), F.col("fields")[0]["number"].alias("o_custkey"), F.col("fields")[1]["text"].alias("o_orderstatus"))


@_query("SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 5")
def kv_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3."""
    found = _order_fields(spark, sf_dir).search(5)
    return spark.createDataFrame([(found[0][1], found[1][1])] if found else [], "o_custkey long, o_orderstatus string")


@_query("SELECT o_orderkey AS key, CASE WHEN o_orderkey = 7 THEN -7 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey BETWEEN 1 AND 50 AND o_orderkey <> 9")
def kv_put_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert, a delete and a delete of a missing key."""
    table = _order_fields(spark, sf_dir)
    if table.search(7) is not None:
        table.put([(7, [(1, -7)])])
    table.delete(9, (1 << 64) - 1)
    return table.range_scan(1, 50).select(F.col("key").cast("bigint").alias("key"), F.col("fields")[0]["number"].alias("o_custkey"))


def _order_fields(spark: SparkSession, sf_dir: str) -> KeyValueTable:
    table = KeyValueTable(spark, _root(spark))
    none = {"number": "bigint", "text": "string", "numbers": "array<bigint>", "texts": "array<string>"}

    def tagged(tag: int, kind: str, name: str, column: str):
        parts = [F.lit(tag).alias("tag"), F.lit(kind).alias("kind")]
        return F.struct(*parts, *[(F.col(column) if n == name else F.lit(None).cast(t)).alias(n) for n, t in none.items()])

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    fields = F.array(tagged(1, "int", "number", "o_custkey"), tagged(2, "text", "text", "o_orderstatus"))
    table.put_frame(orders.select((F.lit(-(1 << 63)) + F.col("o_orderkey")).alias("k"), fields.alias("fields")))
    return table


@_query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1."""
    engine = managed(spark, sf_dir, "region", "r_name")
    engine.sql("INSERT INTO region VALUES (99, 'ATLANTIS')")
    return engine.sql("SELECT * FROM region")


@_query("SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'near' ELSE s_name END AS s_name, s_nationkey::BIGINT AS s_nationkey FROM supplier")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5."""
    engine = managed(spark, sf_dir, "supplier", "s_name", "s_nationkey")
    engine.sql("UPDATE supplier SET s_name = 'near' WHERE s_nationkey < 5")
    return engine.sql("SELECT * FROM supplier")


@_query("SELECT s_suppkey, 'all' AS s_name FROM supplier")
def update_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = managed(spark, sf_dir, "supplier", "s_name")
    engine.sql("UPDATE supplier SET s_name = 'all'")
    return engine.sql("SELECT * FROM supplier")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_custkey < 50 OR o_orderstatus = 'F')")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6."""
    engine = managed(spark, sf_dir, "orders", "o_custkey", "o_orderstatus")
    engine.sql("DELETE FROM orders WHERE o_custkey < 50 OR o_orderstatus = 'F'")
    return engine.sql("SELECT o_orderkey, o_custkey FROM orders")


@_query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region WHERE false")
def delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = managed(spark, sf_dir, "region", "r_name")
    engine.sql("DELETE FROM region")
    return engine.sql("SELECT * FROM region")


@_query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def rollback_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T6."""
    engine = managed(spark, sf_dir, "nation", "n_name")
    txn = engine.begin()
    txn.sql("DELETE FROM nation WHERE n_nationkey = 1")
    txn.sql("UPDATE nation SET n_name = 'x' WHERE n_nationkey = 2")
    txn.sql("INSERT INTO nation VALUES (99, 'y')")
    engine.rollback(txn.id)
    return engine.sql("SELECT * FROM nation")


@_query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey = 2 THEN 'x' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 1 UNION ALL SELECT 99, 'y'")
def commit_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, S5."""
    engine = managed(spark, sf_dir, "nation", "n_name")
    txn = engine.begin()
    txn.sql("DELETE FROM nation WHERE n_nationkey = 1")
    txn.sql("UPDATE nation SET n_name = 'x' WHERE n_nationkey = 2")
    txn.sql("INSERT INTO nation VALUES (99, 'y')")
    engine.commit(txn.id)
    return Engine(spark, engine.store.root).sql("SELECT * FROM nation")


@_query("SELECT * FROM (VALUES (3::BIGINT, 'north', 40::BIGINT, true), (8::BIGINT, 'south', 41::BIGINT, false)) AS t(id, shelf, boxes, full_)")
def drop_recreate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, C2, C5."""
    engine = Engine(spark, _root(spark))
    for sql in (
        "CREATE TABLE shelves (id INT, shelf TEXT)",
        "INSERT INTO shelves VALUES (3, 'old')",
        "DROP TABLE shelves",
        "CREATE TABLE shelves (id INT, shelf TEXT, boxes INT, full_ BOOL)",
        "INSERT INTO shelves VALUES (8, 'south', 5, FALSE)",
        "INSERT INTO shelves VALUES (3, 'north', 40, true)",
        "UPDATE shelves SET boxes = 41 WHERE id = 8",
    ):
        engine.sql(sql)
    return engine.sql("SELECT * FROM shelves")


def _refused(engine: Engine, *sqls: str) -> None:
    """Statements that must fail with an execution error."""
    for sql in sqls:
        try:
            engine.sql(sql)
        except ExecutionError:
            continue
        raise AssertionError(f"{sql} was not refused")


@_query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def insert_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused leaves the table as it was."""
    engine = managed(spark, sf_dir, "region", "r_name")
    _refused(
        engine,
        "INSERT INTO ghost VALUES (9, 'x')",
        "INSERT INTO region VALUES (9)",
        "INSERT INTO region VALUES (9, 'x', 'y')",
        "INSERT INTO region VALUES (1, 'twice')",
        "INSERT INTO region VALUES ('9', 'x')",
        "INSERT INTO region VALUES (9, 5)",
        "INSERT INTO region VALUES (9, true)",
        "INSERT INTO region VALUES (4294967296, 'x')",
    )
    return engine.sql("SELECT * FROM region")


@_query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey FROM supplier")
def update_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, unknown column, other type, and an integer out of range, which fails only if a row would take it."""
    engine = managed(spark, sf_dir, "supplier", "s_name", "s_nationkey")
    _refused(
        engine,
        "UPDATE supplier SET s_suppkey = 5",
        "UPDATE supplier SET ghost = 5",
        "UPDATE supplier SET s_nationkey = 'x'",
        "UPDATE supplier SET s_nationkey = 9223372036854775808",
        "UPDATE supplier SET s_nationkey = 9223372036854775808 WHERE s_suppkey = 1",
    )
    engine.sql("UPDATE supplier SET s_nationkey = 9223372036854775808 WHERE s_suppkey = 4294967295")
    return engine.sql("SELECT * FROM supplier")


_NULLS = "SELECT CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS n_name, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_regionkey END AS n_regionkey, n_nationkey FROM nation"


def _nulls(name: str, where: str, oracle: str) -> None:
    """a comparison with null is FALSE, in every operator, under AND and under OR."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{_root(spark)}/nulls.parquet"
        nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
        holes = nation.select("n_nationkey", F.expr("CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS n_name"), F.expr("CASE WHEN n_nationkey % 2 <> 0 THEN n_regionkey END AS n_regionkey"))
        holes.write.parquet(path)
        engine = Engine(spark, _root(spark))
        engine.register("holes", path, "n_nationkey")
        return engine.sql(f"SELECT * FROM holes WHERE {where}")

    QUERIES[name] = query
    ORACLE_SQL[name] = f"SELECT * FROM ({_NULLS}) WHERE coalesce({oracle}, false)"


_nulls("null_ne", "n_name != 'CHINA'", "n_name <> 'CHINA'")
_nulls("null_le", "n_regionkey <= 9", "n_regionkey <= 9")
_nulls("null_and_or", "n_regionkey >= 0 AND n_name > 'A' OR n_name < 'B'", "n_regionkey >= 0 AND n_name > 'A' OR n_name < 'B'")


@_query(f"SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM ({_NULLS}) WHERE NOT coalesce(n_name >= 'A', false)")
def null_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row whose condition is null stays."""
    engine = Engine(spark, _root(spark))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.expr("CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS n_name"))
    engine.create_from("holes", nation, "n_nationkey")
    engine.sql("DELETE FROM holes WHERE n_name >= 'A'")
    return engine.sql("SELECT * FROM holes")


@_query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region UNION ALL SELECT 50, 'kept'")
def ddl_not_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollback undoes rows, not tables."""
    engine = managed(spark, sf_dir, "region", "r_name")
    txn = engine.begin()
    for sql in ("CREATE TABLE extra (id INT, s TEXT)", "INSERT INTO extra VALUES (1, 'undone')", "DELETE FROM region"):
        txn.sql(sql)
    engine.rollback(txn.id)
    engine.sql("INSERT INTO extra VALUES (50, 'kept')")
    both = engine.sql("SELECT * FROM region").union(engine.sql("SELECT * FROM extra"))
    txn = engine.begin()
    txn.sql("DROP TABLE extra")
    engine.rollback(txn.id)
    _refused(engine, "SELECT * FROM extra", "INSERT INTO extra VALUES (2, 'x')")
    return both


@_query("SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 0 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey <> 9 UNION ALL SELECT 4000000000, 1")
def small_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D5, D6 by key range: one row in, one changed, one out."""
    engine = managed(spark, sf_dir, "orders", "o_custkey")
    for sql in ("INSERT INTO orders VALUES (4000000000, 1)", "UPDATE orders SET o_custkey = 0 WHERE o_orderkey = 7", "DELETE FROM orders WHERE o_orderkey = 9"):
        engine.sql(sql)
    return engine.sql("SELECT * FROM orders")


@_query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def compact_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = managed(spark, sf_dir, "customer", "c_name", "c_mktsegment")
    engine.compact("customer")
    return engine.sql("SELECT * FROM customer")
