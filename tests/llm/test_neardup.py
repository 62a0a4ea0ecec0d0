import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from slateql.llm import graph
from slateql.llm.graph import components
from slateql.llm.neardup import _in_parts, near_duplicates
from slateql.llm.survivors import drop_near_duplicates


def shingles(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, groups, copies, n_words, edits):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(400)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(n_words)]
        for _ in range(copies):
            ws = list(base)
            for _ in range(rng.randrange(edits)):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            rows.append(" ".join(ws))
    rows += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, sig string, n int").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("small,block", [(24, 256), (3, 12)])
def test_against_brute_force(spark, small, block):
    rows = corpus(1, 12, 9, 120, 5) + [(10_000 + i, t) for i, t in corpus(2, 1, 70, 150, 7)]
    assert found(spark, rows, percent=85, small=small, block=block) == brute(rows, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_recall_on_whole_documents(spark, percent):
    """Every link among the test documents, by an exact join, is found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, holders, common = {i: shingles(t) for i, t in rows}, {}, Counter()
    for i in sorted(sets):
        for g in sets[i]:
            common.update((j, i) for j in holders.get(g, ()))
            holders.setdefault(g, []).append(i)
    up = {i: i for i in sets}
    find = lambda i: i if up[i] == i else find(up[i])
    links = 0
    for (i, j), n in common.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            up[b] = a
            links += 1
    assert links > 20
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, percent).collect()} == {i: find(i) for i in sets}


def test_large_nodes_at_the_last_level_are_cut_into_parts(spark):
    """Long documents that share most of their text without being near duplicates stay in one node to the last level."""
    rng = random.Random(6)
    shared = [f"s{k}" for k in range(700)]
    rows = []
    for k in range(40):
        own = [f"d{k}x{i}" for i in range(170)]
        rows.append(" ".join(shared + own))
        if k % 4 == 0:
            rows.append(" ".join(shared + own[:160] + ["z"] * 3))
    rows += ["word " * 50_000 + " ".join(f"tail{i}" for i in range(n)) for n in (100, 101)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    wanted = brute(rows, 80)
    assert found(spark, rows, percent=80, small=3, block=5, max_depth=2, held=2_000) == wanted
    assert 30 < sum(k for *_, k in wanted.values()) < len(rows)


def test_parts_meet_pairwise(spark):
    rows = spark.createDataFrame([(n, r, 1) for n, size in ((1, 50), (2, 3), (3, 21)) for r in range(size)], "node long, rep long, n int")
    met, groups = set(), {}
    for r in _in_parts(rows, F.col("n"), 10).collect():
        groups.setdefault(r.node, []).append(r.rep)
    for g in groups.values():
        met |= {(a, b) for a in g for b in g if a < b}
    assert met >= {(a, b) for b in range(50) for a in range(b)}
    assert max(map(len, groups.values())) < 45 and sorted(groups[2]) == [0, 1, 2]


def test_rows_of_one_id_with_different_texts_are_not_lost(spark):
    rows = [(2, "x one two three four five six", 1), (2, "y totally other words are here", 2), (2, "y totally other words are here", 2), (3, "Y totally other words are here", 3), (1, None, 4), (1, "", 5), (4, "lone words of a document stay", 6), (None, "a", 7), (None, "a", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __own int").selectExpr("*", "map('k', doc_id) AS gone")
    left = drop_near_duplicates(df)
    assert left.columns == df.columns
    found = sorted(r["__own"] for r in left.collect())
    assert found in ([1, 3, 4, 6, 7, 7], [1, 3, 5, 6, 7, 7])
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a\tB"), (6, "a b c"), (7, "x " * 30_000), (8, "X " * 29_999)]
    got = found(spark, rows, percent=80)
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (1, 6, True), 7: (1, 7, True), 8: (1, 7, False)}


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(-1, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False)]
    assert sorted((r.doc_id or -1) for r in drop_near_duplicates(df).collect()) == [-1, 5]


def test_empty_table(spark):
    assert found(spark, []) == {}


@pytest.mark.parametrize("most", [0, 1000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "MOST_EDGES", most)
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100)] + [(200, 200 + k) for k in range(1, 50)] + [tuple(rng.sample(range(300, 340), 2)) for _ in range(25)] + [(7, 7), (None, 3)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in up}
