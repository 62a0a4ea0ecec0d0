"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are put in a pseudo-random order and cut into blocks. With
weights w that sum to W, block k of a source is a unit job with release
floor(k W / w) and deadline ceil((k + 1) W / w). Earliest deadline first on these
windows meets every deadline, so at any time a source has had within one block of its share
of the *given* weights: these are taken as exact fractions (a float as the decimal that it
prints as) and never rounded.

Long periods. As integers without a common divisor the weights repeat after their sum of
slots. A period of up to ``LONGEST`` slots is simulated once on the driver and
every block's slot follows by arithmetic. A longer one is cut into epochs: at an epoch's
start every source has had the floor of its share, and those with the largest remainders
one more, so all are within one block; between two such states windows cut at the epoch's
ends can be met (any interval demands no more jobs than it has slots). Epochs
do not depend on each other, so tasks simulate them and the slots are joined to the blocks. An epoch has a slot for
the least weight at least, so a weight may be 1 / ``MOST_SLOTS`` of the sum or more.

When a source runs out, the others go on with their weights alone in a new phase, which starts afresh; every
row is scheduled exactly once. Of equal deadlines the source named first goes first; unlisted sources share
``other`` and come last.

Scale. Only a count per source reaches the driver. A source's rows are ordered by a hash
of all their columns and dealt into buckets of about ``bucket_rows`` rows; a rank is a row number
within the bucket plus the counts of the buckets before, so a source with any share of the
rows is dealt over all tasks, and rows of one id, or of none, are too.

Defined cases: a null or unlisted source is mixed as ``other``. Null and repeated ids, and null or long
texts, are ordered by the hash like any value; rows equal in all columns cannot be told apart and
take neighbouring places, within one task. Equal hashes go by ``key``. An empty table gives an empty result. Input columns
keep their names and values: the result has one column more, ``name``, and a name that is
taken is an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slateql.llm.exprs import hashable
from slateql.llm.process import tidy

MAX_SOURCES = 1_000
#: Slots that are simulated at a time.
LONGEST = 1 << 16
#: Slots in which the least weight has one block, at most.
MOST_SLOTS = 1 << 20
MAX_BROADCAST = 200_000


def exact_weights(weights: Sequence[float]) -> list[int]:
    """The smallest integers in the same proportions."""
    if not weights or len(weights) > MAX_SOURCES + 1 or any(not w > 0 or w == float("inf") for w in weights):
        raise ValueError(f"1 to {MAX_SOURCES} positive weights are needed")
    exact = [Fraction(str(w)) if isinstance(w, float) else Fraction(w) for w in weights]
    scale = lcm(*[w.denominator for w in exact])
    whole = [int(w * scale) for w in exact]
    whole = [w // gcd(*whole) for w in whole]
    if sum(whole) > MOST_SLOTS * min(whole):
        raise ValueError(f"a weight is less than 1/{MOST_SLOTS} of the sum")
    return whole


def state(weights: Sequence[int], t: int) -> list[int]:
    """Blocks that each source has had before an epoch that starts at slot ``t``; they sum to ``t``."""
    q = sum(weights)
    out = [t * w // q for w in weights]
    order = sorted(range(len(weights)), key=lambda s: (-(t * weights[s] % q), s))
    for s in order[: t - sum(out)]:
        out[s] += 1
    return out


def windows(q: int, w: int, k: int) -> tuple[int, int]:
    """Release and deadline of block ``k``: it takes a slot from the one on, before the other."""
    return k * q // w, -(-(k + 1) * q // w)


def epoch_slots(weights: Sequence[int], begin: int, end: int) -> list[list[int]]:
    """The slots from ``begin`` to ``end`` that each source takes, by earliest deadline first among released blocks."""
    q = sum(weights)
    done, last = state(weights, begin), state(weights, end)
    slots: list[list[int]] = [[] for _ in weights]
    waiting = [(windows(q, w, done[s])[0], s) for s, w in enumerate(weights) if done[s] < last[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    for t in range(begin, end):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (min(end, windows(q, weights[s], done[s])[1]), s))
        s = heapq.heappop(ready)[1]
        slots[s].append(t)
        done[s] += 1
        if done[s] < last[s]:
            heapq.heappush(waiting, (windows(q, weights[s], done[s])[0], s))
    return slots


@dataclass(frozen=True)
class Phase:
    """From slot ``start`` on, ``end`` slots for ``sources``; ``first`` are the blocks that they had before."""

    sources: tuple[int, ...]
    weights: tuple[int, ...]
    first: tuple[int, ...]
    start: int
    end: int
    epoch: int
    placed: tuple[int, ...]

    @property
    def periodic(self) -> bool:
        return self.epoch == sum(self.weights)

    def of_epoch(self, e: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(source, block, slot, release, deadline) of an epoch's blocks."""
        q = sum(self.weights)
        begin = e * self.epoch
        before = state(self.weights, begin)
        for k, slots in enumerate(epoch_slots(self.weights, begin, begin + self.epoch)):
            for i, t in enumerate(slots):
                if t < self.end:
                    release, deadline = windows(q, self.weights[k], before[k] + i)
                    yield self.sources[k], self.first[k] + before[k] + i, self.start + t, self.start + release, self.start + deadline


def schedule(blocks: Sequence[int], weights: Sequence[int], longest: int = LONGEST) -> list[Phase]:
    """Phases between the ends of sources; ``blocks`` counts each source's blocks."""
    left, done = list(blocks), [0] * len(blocks)
    out: list[Phase] = []
    start = 0
    while any(left):
        sources = tuple(s for s, n in enumerate(left) if n)
        own = exact_weights([weights[s] for s in sources])
        q = sum(own)
        epoch = q if q <= longest else max(longest, -(-q // min(own)))

        def epoch_of(k: int, block: int) -> int:
            e = max(0, block * q // own[k] // epoch - 1)  # noqa: B023
            while state(own, (e + 1) * epoch)[k] <= block:  # noqa: B023
                e += 1
            return e

        ends = [epoch_of(k, left[s] - 1) for k, s in enumerate(sources)]
        e = min(ends)
        before, slots = state(own, e * epoch), epoch_slots(own, e * epoch, (e + 1) * epoch)
        end = min(slots[k][left[s] - 1 - before[k]] for k, s in enumerate(sources) if ends[k] == e) + 1
        placed = [before[k] + sum(t < end for t in slots[k]) for k in range(len(sources))]
        out.append(Phase(sources, tuple(own), tuple(done[s] for s in sources), start, end, epoch, tuple(placed)))
        for s, n in zip(sources, placed):
            done[s] += n
            left[s] -= n
        start += end
    return out


def _table(spark: SparkSession, rows: Sequence[tuple], schema: pa.Schema) -> DataFrame:
    """A small table, read from Arrow by the JVM; executors would start further Python workers for a list of rows."""
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema))


_PHASES = pa.schema([("p_group", pa.int32()), *[(c, pa.int64()) for c in ("p_first", "p_end", "w", "q", "start")], ("slots", pa.list_(pa.int64()))])


def _by_arithmetic(blocks: DataFrame, phases: list[Phase]) -> DataFrame:
    rows = []
    for p in phases:
        slots = epoch_slots(p.weights, 0, p.epoch)
        rows += [(s, f, f + n, w, p.epoch, p.start, t) for s, f, n, w, t in zip(p.sources, p.first, p.placed, p.weights, slots)]
    table = _table(blocks.sparkSession, rows, _PHASES)
    at = (F.col("group") == F.col("p_group")) & (F.col("block") >= F.col("p_first")) & (F.col("block") < F.col("p_end"))
    k = "(block - p_first)"
    return blocks.join(F.broadcast(table), at).select(
        *blocks.columns,
        F.expr(f"start + {k} div w * q + get(slots, cast({k} % w as int))").alias("slot"),
        F.expr(f"start + {k} * q div w").alias("release"),
        F.expr(f"start + (({k} + 1) * q + w - 1) div w").alias("deadline"),
    )


_SLOTS = pa.schema([("group", pa.int32()), ("block", pa.int64()), ("slot", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64())])


def _by_epochs(blocks: DataFrame, phases: list[Phase]) -> DataFrame:
    spark = blocks.sparkSession
    first, total = [], 0
    for p in phases:
        first.append(total)
        total += -(-p.end // p.epoch)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e in batch.column(0).to_pylist():
                k = max(k for k, f in enumerate(first) if f <= e)
                found = list(phases[k].of_epoch(e - first[k]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _SLOTS)], schema=_SLOTS)

    tasks = max(1, min(total, spark.sparkContext.defaultParallelism * 4))
    slots = spark.range(0, total, 1, tasks).mapInArrow(tidy(emit), "group int, block bigint, slot bigint, release bigint, deadline bigint")
    slots = F.broadcast(slots) if sum(p.end for p in phases) <= MAX_BROADCAST else slots
    return blocks.join(slots, ["group", "block"]).select(*blocks.columns, "slot", "release", "deadline")


def mix(df: DataFrame, weights: Mapping[str, float], other: float = 1.0, block_rows: int = 16, bucket_rows: int = 2_048, source: str = "source", key: str = "doc_id", name: str = "__mixed", longest: int = LONGEST, order: Column | None = None) -> DataFrame:
    """``df`` and ``name``, a struct of source (null: other), block, within, slot, release and deadline; (slot, within) order the mixture.

    ``order`` is a bigint, by default a hash of all columns, that puts a source's rows in order and into buckets.
    """
    if name in df.columns:
        raise ValueError(f"column {name} is there already")
    spark, sources = df.sparkSession, list(weights)
    whole = exact_weights([*weights.values(), other])
    group = F.coalesce(*[F.when(F.col(source) == s, F.lit(k)) for k, s in enumerate(sources)], F.lit(len(sources)))
    digest = order if order is not None else F.xxhash64(*[c for c in df.columns if hashable(df.schema[c].dataType)])
    grouped = df.select(F.struct("*").alias("row"), group.alias("group"), digest.alias("h"))
    counts = {r["group"]: r["count"] for r in grouped.groupBy("group").count().collect()}
    buckets = _table(spark, [(g, -(-n // bucket_rows)) for g, n in counts.items()], pa.schema([("group", pa.int32()), ("buckets", pa.int64())]))
    dealt = grouped.join(F.broadcast(buckets), "group").withColumn("bucket", F.pmod("h", F.col("buckets"))).drop("buckets")

    sizes = dealt.groupBy("group", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("group", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    offsets = F.broadcast(offsets) if sum(-(-n // bucket_rows) for n in counts.values()) <= MAX_BROADCAST else offsets
    within = Window.partitionBy("group", "bucket").orderBy("h", F.col("row")[key])
    rank = F.col("before") + F.row_number().over(within) - 1
    ranked = dealt.join(offsets, ["group", "bucket"]).select("row", "group", rank.alias("rank"))
    blocks = ranked.select("row", "group", F.expr(f"rank div {block_rows}").alias("block"), (F.col("rank") % block_rows).alias("within"))

    phases = schedule([-(-counts.get(g, 0) // block_rows) for g in range(len(whole))], whole, longest)
    placed = (_by_arithmetic if all(p.periodic for p in phases) else _by_epochs)(blocks, phases)
    named = F.get(F.array(*map(F.lit, sources)), F.col("group")) if sources else F.lit(None).cast("string")
    return placed.select(*[F.col("row")[c].alias(c) for c in df.columns], F.struct(named.alias("source"), "block", "within", "slot", "release", "deadline").alias(name))
