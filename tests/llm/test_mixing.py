from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from slateql.llm import mixing, settings


def test_exact_weights():
    assert mixing.exact_weights([2, 4, 6]) == [1, 2, 3]
    assert mixing.exact_weights([0.1, 0.25, 1]) == [2, 5, 20]
    assert mixing.exact_weights([1, 1e-4]) == [10_000, 1]
    assert mixing.exact_weights([Fraction(1, 3), 1]) == [1, 3]
    for bad in ([], [0], [-1], [float("nan")], [float("inf")], [1, 1e-7]):
        with pytest.raises(ValueError):
            mixing.exact_weights(bad)


REGISTERED = [*settings.SOURCE_WEIGHTS.values(), settings.OTHER_WEIGHT]


@pytest.mark.parametrize("weights", [REGISTERED, [0.1, 0.7, 0.2], [1, 1e-4], [1 / 3, 0.1234567, 2.5, 1e-4], [3]])
def test_within_one_block_of_the_given_weights(weights):
    """To a million slots, at every one of them."""
    exact = [Fraction(str(w)) for w in weights]
    total = sum(exact)
    blocks = [int(1_000_000 * w / total) + 2 for w in exact]
    (phase, *_) = mixing.schedule(blocks, mixing.exact_weights(weights))
    assert phase.end >= 1_000_000
    share = [float(w / total) for w in exact]
    seen, taken = [0] * len(weights), {}
    for e in range(-(-1_000_000 // phase.epoch)):
        for s, block, slot, release, deadline in phase.of_epoch(e):
            assert slot not in taken and release <= slot < deadline
            taken[slot] = s
    for t in range(1_000_000):
        seen[taken[t]] += 1
        assert all(abs(n - (t + 1) * w) < 1 + 1e-6 for n, w in zip(seen, share))


def brute(blocks, weights):
    """slot -> (source, block): earliest deadline first over windows in fractions, anew when a source runs out."""
    left, done, start, out = dict(enumerate(blocks)), Counter(), 0, {}
    left = {s: n for s, n in left.items() if n}
    while left:
        total, t, had = sum(Fraction(str(weights[s])) for s in left), 0, Counter()
        share = {s: Fraction(str(weights[s])) / total for s in left}
        ended = False
        while not ended:
            ready = [s for s in left if had[s] // share[s] <= t]
            s = min(ready, key=lambda s: (-(-(had[s] + 1) // share[s]), s))
            out[start + t] = (s, done[s])
            had[s] += 1
            done[s] += 1
            left[s] -= 1
            t += 1
            if not left[s]:
                del left[s]
                ended = True
        start += t
    return out


@pytest.mark.parametrize("weights,other", [({"big": 1, "x": 3}, 2), ({"big": 0.35, "x": 0.15, "none": 4}, 0.5), ({}, 1)])
def test_query_equals_earliest_deadline_first(spark, weights, other):
    rows = [(i, "big" if i % 3 else ("x" if i % 2 else None), 0) for i in range(1000)] + [(None, "big", 1), (5, "x", 2), (5, "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, block int")
    found = mixing.mix(df, weights, other=other, block_rows=4, bucket_rows=100).collect()
    assert Counter((r.doc_id, r.source, r.block) for r in found) == Counter(rows)
    names = {s: k for k, s in enumerate(weights)}
    got = defaultdict(set)
    for r in found:
        m = r["__mixed"]
        assert m.source == (r.source if r.source in names else None) and m.release <= m.slot < m.deadline and 0 <= m.within < 4
        got[m.slot].add((names.get(m.source, len(names)), m.block))
    sizes = Counter(names.get(s, len(names)) for _, s, _ in rows)
    wanted = brute([-(-sizes[g] // 4) for g in range(len(names) + 1)], [*weights.values(), other])
    assert {t: {x} for t, x in wanted.items()} == got
    per_block = Counter((r["__mixed"].source, r["__mixed"].block) for r in found)
    assert sum(n < 4 for n in per_block.values()) <= len(names) + 1  # only last blocks are short


def test_long_periods_are_cut_into_epochs(spark):
    weights, other = {"a": 0.7123, "b": 0.2871}, 0.0101
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 6 THEN 'a' WHEN id % 10 < 9 THEN 'b' END AS source")
    found = mixing.mix(df, weights, other, block_rows=2, longest=64).collect()
    slots = Counter(r["__mixed"].slot for r in found)
    assert sorted(slots) == list(range(1500)) and set(slots.values()) == {2}
    assert all(r["__mixed"].release <= r["__mixed"].slot < r["__mixed"].deadline for r in found)
    assert len({(r["__mixed"].source, r["__mixed"].block) for r in found}) == 1500
    served, total = Counter(), sum(map(Fraction, ("0.7123", "0.2871", "0.0101")))
    order = {r["__mixed"].slot: r["__mixed"].source for r in found}
    for t in range(1200):
        served[order[t]] += 1
        for s, w in (("a", "0.7123"), ("b", "0.2871"), (None, "0.0101")):
            assert abs(served[s] - (t + 1) * Fraction(w) / total) < 1


def test_clashing_names_nulls_and_hot_ids(spark):
    rows = [(None, "a", "t" * k, k) for k in range(500)] + [(7, None, None, k) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, h int").selectExpr("*", "doc_id AS row", "h AS slot", "h AS __h", "map('k', h) AS m")
    found = mixing.mix(df, {"a": 1}, block_rows=8, bucket_rows=50)
    assert found.columns == [*df.columns, "__mixed"]
    got = found.collect()
    assert Counter((r.doc_id, r.source, r.text, r.h) for r in got) == Counter(rows) and all(r.slot == r["__h"] == r.h == r.m["k"] for r in got)
    again = mixing.mix(df.repartition(7), {"a": 1}, block_rows=8, bucket_rows=50).collect()
    place = lambda found: sorted((r["__mixed"].slot, r["__mixed"].within, r.h) for r in found)
    assert place(got) == place(again)
    with pytest.raises(ValueError):
        mixing.mix(found, {"a": 1})


def test_mix_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mix(df, {"a": 1}).count() == 0
