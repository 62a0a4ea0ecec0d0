"""Connected components of an edge table: alternating large and small stars, or, of a small table, union-find in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateql.llm.process import tidy
from slateql.sources.shared import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialised in the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Tables of up to so many edges, about 100 MB in a worker, are joined up by one task.
MOST_EDGES = 500_000


class UnionFind(dict):
    """node -> a node nearer to the least one of its component."""

    def find(self, k: int) -> int:
        up = self.setdefault(k, k)
        while self[up] != up:
            self[k] = self[up]
            k, up = self[up], self[self[up]]
        return up

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self[max(i, j)] = min(i, j)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            sets.join(a, b)
    ids = list(sets)
    for at in range(0, len(ids), 100_000):
        part = ids[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(map(sets.find, part), pa.int64())], names=["id", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node points its larger (large star) or smaller (small star) neighbours to its least one."""
    near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = out.where("a != b")
    return out if large else out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of an edge (a, b); the component is its smallest id.

    Rounds of stars grow with the logarithm of a component's diameter. Null ends and
    loops are ignored.
    """
    current = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if current.count() <= MOST_EDGES:
        return current.coalesce(1).mapInArrow(tidy(_joined), "id bigint, component bigint")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = print_of(current)
    while True:
        current = checkpointed(_star(_star(current, large=True), large=False))
        now = print_of(current)
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(current.select(F.col("b"), F.col("b")).distinct())
