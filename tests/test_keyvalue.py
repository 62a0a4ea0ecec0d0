import random

import pytest
from pyspark.sql import functions as F

from slateql.errors import ExecutionError
from slateql.operators.keyvalue import KeyValueTable, value_of


@pytest.fixture
def table(spark, tmp_path):
    return KeyValueTable(spark, str(tmp_path / "kv"))


def scan(t, low, high):
    return [(int(r.key), [(f["tag"], value_of(f)) for f in r.fields]) for r in t.range_scan(low, high).collect()]


def test_fields_round_trip(spark, table):
    fields = [(0, 7), (1, "ünï"), (2, None), (3, ["a", ""]), (4, [1, -2]), (5, [])]
    table.put([(1, fields), ((1 << 64) - 1, [(0, -(1 << 63))]), (0, [])])
    assert table.search(1) == fields
    assert table.search((1 << 64) - 1) == [(0, -(1 << 63))]
    assert table.search(2) is None
    assert [k for k, _ in scan(KeyValueTable(spark, table.root), 0, (1 << 64) - 1)] == [0, 1, (1 << 64) - 1]


def test_range_scans_against_a_model(table):
    """Random unsigned 64-bit keys, both ends of the signed range among them, and random ranges."""
    rng = random.Random(17)
    keys = sorted({rng.getrandbits(64) >> rng.randrange(64) for _ in range(200)} | {(1 << 63) - 1, 1 << 63})
    table.put([(k, [(0, k % 1000)]) for k in rng.sample(keys, len(keys))])
    for low, high in [tuple(rng.choices(keys, k=2)) for _ in range(6)] + [(keys[-1] - 1, keys[-1]), (3, 2)]:
        assert scan(table, low, high) == [(k, [(0, k % 1000)]) for k in keys if low <= k <= high]


def test_against_a_dict(table):
    rng, model = random.Random(2), {}
    for _ in range(6):
        rows = [(rng.randrange(30), [(0, rng.randrange(1000))]) for _ in range(8)]
        table.put(rows)
        model.update(rows)
        gone = rng.sample(range(40), 5)
        table.delete(*gone)
        for k in gone:
            model.pop(k, None)
    assert scan(table, 0, 40) == sorted(model.items())
    table.compact()
    assert scan(table, 0, 40) == sorted(model.items()) and len(table.parts) == 1


def test_empty_and_bad(table):
    assert table.search(1) is None and scan(table, 0, 10) == []
    for row in ((-1, []), (1 << 64, []), (1, [(0, 1.5)]), (1, [(0, [[1]])]), (1, [(256, 1)]), (1, [(0, True)])):
        with pytest.raises(ExecutionError):
            table.put([row])


def test_ranges_reach_the_scan(table):
    table.put([(k, []) for k in range(5)])
    assert "GreaterThanOrEqual(k" in table._latest(F.col("k").between(-5, 5))._jdf.queryExecution().executedPlan().toString()
