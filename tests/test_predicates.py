"""The compiled predicates against a row-by-row evaluator."""

import random

import pytest
from pyspark.sql import types as T

from slateql.functions.literals import ascii_upper, integer
from slateql.functions.predicates import COMPARE, compile_where, holds
from slateql.plans import syntax as S

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("Name", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ok", T.BooleanType())])
ROWS = [
    (1, "alice", 30, True), (2, "bob", -5, False), (3, "", 0, None), (4, None, None, True), (5, "5", 5, False),
    (6, "é", 9223372036854775807, True), (7, "￮", -9223372036854775808, False), (8, "\U0001f600", 7, True), (9, "TRUE", 1, False), (10, "alice", 40, True),
]
TEXTS = ["30", "-5", "+5", "0", "abc", "alice", "true", "FALSE", "maybe", "", "5", "é", "99999999999999999999", "9223372036854775807", "1", " 5", "٥", "\U0001f600", "TRUE"]


def holds_in_python(p, row):
    if isinstance(p, S.Logical):
        left, right = holds_in_python(p.left, row), holds_in_python(p.right, row)
        return (left and right) if p.operator == "AND" else (left or right)
    names = [f.name.lower() for f in SCHEMA.fields]
    if p.column.lower() not in names:
        return False
    value = row[names.index(p.column.lower())]
    if value is None:
        return False
    op = COMPARE[p.operator]
    if isinstance(value, bool):
        return op("TRUE" if value else "FALSE", ascii_upper(p.literal.text))
    if isinstance(value, int):
        number = integer(p.literal.text)
        return number is not None and op(value, number)
    return op(value.encode(), p.literal.text.encode())


def random_predicate(rng, depth):
    if depth and rng.random() < 0.6:
        return S.Logical(rng.choice(["AND", "OR"]), random_predicate(rng, depth - 1), random_predicate(rng, depth - 1))
    return S.Comparison(rng.choice(["id", "NAME", "name", "N", "ok", "ghost"]), rng.choice(list(COMPARE)), S.Literal(rng.choice(["number", "string", "identifier"]), rng.choice(TEXTS)))


def test_against_rows(spark):
    rng = random.Random(5)
    singles = [S.Comparison(c, o, S.Literal("string", t)) for c in ("name", "n", "ok", "ghost") for o in COMPARE for t in TEXTS]
    predicates = singles + [random_predicate(rng, 3) for _ in range(150)]
    df = spark.createDataFrame(ROWS, SCHEMA)
    for at in range(0, len(predicates), 150):
        part = predicates[at : at + 150]
        found = df.select("id", *[holds(p, SCHEMA).alias(f"p{k}") for k, p in enumerate(part)]).collect()
        for row, values in zip(ROWS, sorted(found)):
            for k, p in enumerate(part):
                assert values[f"p{k}"] == holds_in_python(p, row), (p, row)


def test_where_drops_null_predicates(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    p = S.Comparison("n", "!=", S.Literal("number", "1"))
    assert sorted(r.id for r in df.where(compile_where(p, SCHEMA)).collect()) == [r[0] for r in ROWS if r[2] not in (None, 1)]
    assert compile_where(None, SCHEMA) is None


@pytest.mark.parametrize("column,literal", [("o_custkey", "7"), ("o_orderstatus", "F")])
def test_predicates_reach_the_scan(spark, column, literal):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = df.where(compile_where(S.Comparison(column, "=", S.Literal("string", literal)), df.schema)).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo({column},{literal})" in plan
