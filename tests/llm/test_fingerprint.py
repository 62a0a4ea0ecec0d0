import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from slateql.llm import fingerprint as P


def shingles(text):
    ws = text.encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    out = [(0, ""), (1, None), (2, "one"), (3, "é" * 7), (4, "a b c d e"), (5, "A B C D E"), (9, " \n\t ")]
    ids = rng.sample(range(10, 5000), 60) + [1 << 40, -7]
    for i in ids:
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 200, 1500])))
        out.append((i, text))
    return out


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, key int, next_text string").repartition(5)
    found = {r.doc_id: r for r in P.fingerprint_edited(df).collect()}
    order = sorted(rows)
    errors = []
    for k, (i, t) in enumerate(order):
        t, following, r = t or "", order[(k + 1) % len(order)][1] or "", found[i]
        new = edited(t, following)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest()), i
        for got, other in ((r.near_edited, new), (r.near_next, following)):
            assert 0 <= got <= 1
            errors.append(got - jaccard(shingles(t), shingles(other)))
    assert len(found) == len(rows)
    assert max(map(abs, errors)) < 0.15 and sum(e * e for e in errors) / len(errors) < 0.03**2
    assert found[4].fingerprint == found[5].fingerprint != ""
    assert found[0].fingerprint == found[1].fingerprint == found[9].fingerprint == ""


@pytest.mark.parametrize("limit", [0, 1000])
def test_order_with_hot_ids_and_nulls(spark, limit):
    """A third of the rows without id, a third of one id: blocks stay small, and every row is followed by the next."""
    rng = random.Random(3)
    big = 1 << 62
    rows = [(None, f"n{k}") for k in range(300)] + [(5, f"five {k % 250}") for k in range(300)] + [(rng.randrange(-900, 900), f"t{k}") for k in range(200)]
    rows += [(i, f"far {i}") for i in (big, big + 1, big + 300, big + 1023, big + 1024, big + 70_000, -big, -big - 1024, -(1 << 63), (1 << 63) - 1)]
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), seed=42))
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], signed(r[1]), r[1]))
    wanted = sorted((str(i), t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = P.with_next(df, "doc_id", lambda t: {"n": F.length(t)}, block=64, most=20, max_broadcast=limit)
    assert sorted((str(r.key), r.text, r.next_text) for r in found.collect()) == wanted
    assert sorted((str(r.key), r.text, r.next_text) for r in P.with_next(df, "doc_id", lambda t: {"n": F.length(t)}).collect()) == wanted
    docs = df.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), F.xxhash64("text").alias("x"))
    assert P._dealt(docs, 64, 20, limit).groupBy("__b", "__p", "__s").count().agg(F.max("count")).first()[0] < 80


def test_very_long_text(spark):
    text = " ".join(f"w{k % 5000}" for k in range(200_000))
    found = P.fingerprint_edited(spark.createDataFrame([(1, text), (2, text[: len(text) // 2])], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_chars for r in found} == {1: len(text), 2: len(text) // 2} and all(r.near_next > 0.9 for r in found)


def test_bias_is_corrected(spark):
    texts = [" ".join(f"{side}{k}" for k in range(400)) for side in "ab"]
    df = spark.createDataFrame([tuple(texts)], "a string, b string")
    got = df.select(P.likeness(P.fingerprint(F.col("a")), P.fingerprint(F.col("b"))).alias("x")).first().x
    assert got < 0.08  # 1 / 16 of the digits agree by chance


def test_ties_repeated_rows_and_empty_tables(spark):
    same = [(1, "a b c d e f")] * 3 + [(None, "first of all texts")]
    found = P.fingerprint_edited(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0) for r in found) == [0, 1, 1, 1]
    assert sorted(r.near_next for r in found if r.doc_id == 1) == [0.0, 1.0, 1.0]
    assert P.fingerprint_edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = P.fingerprint_edited(spark.createDataFrame([(5, "alone here")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_no_user_functions(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Python" not in P.fingerprint_edited(df)._jdf.queryExecution().executedPlan().toString()
