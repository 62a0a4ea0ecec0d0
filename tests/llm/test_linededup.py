import random
import time
from collections import Counter

import pytest
from slateql.llm import linededup
from slateql.llm.linededup import common_blocks, cut_lines, line_cuts, patience


def cut(spark, rows, min_words=6, parts=3):
    df = spark.createDataFrame([(i, t, 1, "z", 5) for i, t in rows], "doc_id long, text string, blocks int, h string, __cut_id int").repartition(parts)
    found = cut_lines(df, line_cuts(df, min_words)).orderBy("doc_id", "text").collect()
    whole = Counter((i, len(t or "")) for i, t in rows)
    assert whole == Counter((r.doc_id, len(r.text or "") + r["__cut"].chars) for r in found)
    return [(r.doc_id, r.text, r["__cut"].lines) for r in found]


def brute(rows, min_words):
    """Every pair of an earlier and a later document, every pair of places: lines in runs common to both go."""
    out = []
    for doc, text in rows:
        own = text.split("\n")
        ours = [k for k, x in enumerate(own) if x.split()]
        gone = set()
        for earlier, other in rows:
            if earlier >= doc:
                continue
            theirs = [x for x in other.split("\n") if x.split()]
            for a in range(len(ours)):
                for b in range(len(theirs)):
                    n = 0
                    while a + n < len(ours) and b + n < len(theirs) and own[ours[a + n]] == theirs[b + n]:
                        n += 1
                    if sum(len(own[k].split()) for k in ours[a : a + n]) >= min_words:
                        gone.update(range(a, a + n))
        cut_out = set()
        for k in gone:
            cut_out.update(range(ours[k], (ours[k + 1] if k + 1 in gone else ours[k] + 1)))
        out.append((doc, "\n".join(x for k, x in enumerate(own) if k not in cut_out), len(cut_out)))
    return out


@pytest.mark.parametrize("rare", [1, 4])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed, rare):
    """Unsorted documents of repeated, blank and shared lines, some of them copies or collages of others."""
    monkeypatch.setattr(linededup, "RARE", rare)
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdefg") + str(k) for _ in range(rng.randrange(1, 5))) for k in range(25)] + ["", " \t"]
    rows = []
    for i in range(60):
        own = [rng.choice(lines) for _ in range(rng.randrange(0, 14))]
        for _ in range(rng.randrange(3)):
            if rows:
                other = rng.choice(rows)[1].split("\n")
                at = rng.randrange(len(other))
                place = rng.randrange(len(own) + 1)
                own[place:place] = other[at : at + rng.randrange(1, 9)]
        rows.append((i * 3, "\n".join(own)))
    assert cut(spark, rows, 9) == brute(rows, 9)


@pytest.mark.parametrize("limit", [0, 1000])
def test_groups_of_copies(spark, monkeypatch, limit):
    """Passages in many documents: as many pairs as windows, and nothing lost, broadcast or not."""
    monkeypatch.setattr(linededup, "MAX_BROADCAST", limit)
    rng = random.Random(4)
    passages = ["\n".join(f"p{p} line {k} of it" for k in range(4)) for p in range(3)]
    rows = [(i, "\n".join([f"own {i}", *rng.sample(passages, rng.randrange(1, 4)), f"end {i} x"])) for i in range(80)]
    assert cut(spark, rows, 12) == brute(rows, 12)
    docs = spark.createDataFrame([(i, hash(t) % 1000, t) for i, t in rows], "doc_id long, h long, text string")
    assert linededup.document_pairs(linededup.shared_lines(docs, 12), 12).count() <= 80 * 13


def test_a_line_that_an_earlier_document_repeats(spark):
    a, b, c, f = ("ten words " * 5 + x for x in "abcf")
    rows = [(1, "\n".join([f, b, "x x", b])), (2, "\n".join(["own", a, b, c])), (3, "\n".join([f, "y", a, b, c]))]
    assert cut(spark, rows, 25)[2] == (3, "\n".join([f, "y"]), 3)


def test_lines_of_several_documents_are_no_block(spark):
    a, b, c = ("eight words or so stand in line " + x for x in "abc")
    rows = [(1, a), (2, b), (3, c), (4, "\n".join([a, b, c]))]
    assert cut(spark, rows, 20) == [(i, t, 0) for i, t in rows]


def test_hot_line_and_very_long_texts(spark):
    hot = "licence line of words"
    rows = [(i, f"{hot}\nown text {i}\n{hot}") for i in range(300)]
    assert cut(spark, rows, 8) == [(i, t, 0) for i, t in rows]
    long = "\n".join(f"line {k % 7000} and {k}" for k in range(40_000))
    rows = [(1, long), (2, "start\n" + long), (3, "\n".join([hot] * 100_000)), (4, "\n".join([hot] * 100_001))]
    began = time.time()
    assert [(i, len(t), n) for i, t, n in cut(spark, rows, 25)] == [(1, len(long), 0), (2, 5, 40_000), (3, len(rows[2][1]), 0), (4, 0, 100_001)]
    assert time.time() - began < 60


def test_one_repeated_line_is_not_quadratic():
    x = (1, 2)
    began = time.time()
    assert common_blocks(dict.fromkeys(range(50_000), x), dict.fromkeys(range(60_000), x), {x: 4}, 25)
    assert time.time() - began < 5


def test_patience():
    lines = lambda text: dict(enumerate((ord(c), 0) for c in text))
    assert patience(lines("abc"), lines("xabcy")) == {0: 1, 1: 2, 2: 3}
    assert patience(lines("apbpc"), lines("apcpb")) == {0: 0, 1: 1, 4: 2}  # b or c, one of them moved
    assert patience(lines("axbxc"), lines("axxbc")) == {0: 0, 1: 1, 2: 3, 4: 4}
    assert patience(lines("aaa"), lines("aa")) == {}
    assert patience({}, lines("a")) == {}


def test_aligned_blocks_name_the_place_in_the_earlier_document(spark):
    block = "one two three\nfour five six seven"
    df = spark.createDataFrame([(1, f"\nown words here\n{block}"), (2, f"x\n\n{block}\nother things")], "doc_id long, text string")
    (found,) = line_cuts(df, 6).collect()
    assert [b.asDict() for b in found.blocks] == [{"first": 2, "last": 3}]
    assert [b.asDict() for b in found.aligned] == [{"first": 2, "last": 3, "partner": 1, "partner_first": 2}]


def test_defined_cases(spark):
    long = "w1 w2 w3 w4 w5 w6 w7"
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long), (4, "\n\n"), (5, long), (6, f"{long}\n{long}\n{long}")]
    assert cut(spark, rows) == [(None, long, 0), (1, None, 0), (2, "", 0), (3, long, 0), (3, long, 0), (4, "\n\n", 0), (5, "", 1), (6, "", 3)]
    assert cut(spark, [(3, long), (3, f"{long}\n{long}"), (4, f"x\n{long}")]) == [(3, long, 0), (3, f"{long}\n{long}", 0), (4, "x", 1)]
    assert cut(spark, []) == []
