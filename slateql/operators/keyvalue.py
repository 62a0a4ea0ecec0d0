"""A key-value table: unsigned 64-bit keys to lists of tagged fields, with range scans.

A log of Parquet files: every write appends rows (key, version, fields, deleted), and
the latest version of a key holds. A key is stored as a signed long, 2^63
less, which keeps its order and lets ranges reach the scan as pushed filters;
point and range reads therefore read few row groups, and only then look for the latest versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slateql.errors import ExecutionError

MOST_KEY = (1 << 64) - 1
_SHIFT = 1 << 63
FIELD = T.StructType(
    [
        T.StructField("tag", T.IntegerType()),
        T.StructField("kind", T.StringType()),  # null, int, text, ints or texts
        T.StructField("number", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("numbers", T.ArrayType(T.LongType())),
        T.StructField("texts", T.ArrayType(T.StringType())),
    ]
)
LOG = T.StructType([T.StructField("k", T.LongType()), T.StructField("version", T.LongType()), T.StructField("deleted", T.BooleanType()), T.StructField("fields", T.ArrayType(FIELD))])


def field(tag: int, value) -> tuple:
    """A tagged null, integer, text, or list of one of the latter two."""
    if not 0 <= tag <= 255:
        raise ExecutionError(f"tag {tag} is not from 0 to 255")
    if value is None:
        return tag, "null", None, None, None, None
    if isinstance(value, bool):
        raise ExecutionError("a field is null, an integer, a text or a list")
    if isinstance(value, int):
        return tag, "int", value, None, None, None
    if isinstance(value, str):
        return tag, "text", None, value, None, None
    if isinstance(value, list) and len(value) <= 65_535 and not any(isinstance(v, bool) for v in value):
        if all(isinstance(v, int) for v in value):
            return tag, "ints", None, None, value, None
        if all(isinstance(v, str) for v in value):
            return tag, "texts", None, None, None, value
    raise ExecutionError("a field is null, an integer, a text or a list of one of these")


def value_of(f) -> object:
    return {"null": None, "int": f["number"], "text": f["text"], "ints": f["numbers"], "texts": f["texts"]}[f["kind"]]


def stored(key: int) -> int:
    if not 0 <= key <= MOST_KEY:
        raise ExecutionError(f"key {key} is not an unsigned 64-bit integer")
    return key - _SHIFT


def shown(k: Column) -> Column:
    return (k.cast("decimal(20,0)") + F.expr(f"CAST({_SHIFT} AS DECIMAL(20,0))")).cast("decimal(20,0)")


class KeyValueTable:
    """One writer at a time; readers may be many."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self.parts = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if self._complete(s.getPath()))
        self.version = int(self.parts[-1].split("-")[0]) if self.parts else 0

    def _complete(self, path) -> bool:
        return self._fs.exists(self._path(path, "_SUCCESS"))

    def _append(self, df: DataFrame) -> None:
        name = f"{self.version + 1:012d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        self.version += 1
        self.parts.append(name)

    def put(self, rows: Iterable[tuple[int, list[tuple[int, object]]]]) -> None:
        """Inserts or replaces; of one key's rows in a call the last holds."""
        last = {stored(k): [field(*f) for f in fields] for k, fields in rows}
        log = [(k, self.version + 1, False, f) for k, f in sorted(last.items())]
        self._append(self.spark.createDataFrame(log, LOG).coalesce(1))

    def put_frame(self, df: DataFrame) -> None:
        """Bulk insert or replace of distinct keys; ``df`` has ``k`` (stored form) and ``fields``."""
        rows = df.select("k", F.lit(self.version + 1).cast("long").alias("version"), F.lit(False).alias("deleted"), "fields")
        self._append(rows.repartitionByRange("k").sortWithinPartitions("k"))

    def delete(self, *keys: int) -> None:
        """Missing keys are ignored."""
        log = [(k, self.version + 1, True, None) for k in sorted(map(stored, keys))]
        self._append(self.spark.createDataFrame(log, LOG).coalesce(1))

    def _latest(self, where: Column | None) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], "k long, fields array<string>").select("k", F.array().cast(T.ArrayType(FIELD)).alias("fields"))
        log = self.spark.read.schema(LOG).parquet(*[f"{self.root}/{p}" for p in self.parts])
        log = log if where is None else log.where(where)
        if len(self.parts) == 1:
            return log.where("NOT deleted").select("k", "fields")
        newest = log.groupBy("k").agg(F.max_by(F.struct("deleted", "fields"), "version").alias("r"))
        return newest.where("NOT r.deleted").select("k", "r.fields")

    def search(self, key: int) -> list[tuple[int, object]] | None:
        row = self._latest(F.col("k") == stored(key)).first()
        return None if row is None else [(f["tag"], value_of(f)) for f in row.fields]

    def range_scan(self, low: int, high: int) -> DataFrame:
        """(key, fields) of the keys from ``low`` to ``high``, both included, ascending."""
        rows = self._latest(F.col("k").between(stored(low), stored(high)))
        return rows.orderBy("k").select(shown(F.col("k")).alias("key"), "fields")

    def compact(self) -> None:
        """All live rows in one part of disjoint key ranges; the old parts are removed."""
        old = list(self.parts)
        self.put_frame(self._latest(None))
        self.parts = self.parts[-1:]
        for p in old:
            self._fs.delete(self._path(f"{self.root}/{p}"), True)
