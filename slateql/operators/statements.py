"""The statements as DataFrame plans over a table's state.

The key ranges in the manifest leave out files that no row of a statement can lie in. UPDATE and DELETE rewrite
only the files that hold a matching row: a first pass
with the pushed-down predicate names them, the rest are carried over by name. Small files are merged by size: ``FAN`` of about
one size become one, so a row is rewritten once for every ``FAN``-fold growth, and a file of half ``TARGET`` bytes or half ``MOST_ROWS`` rows or more is left alone.
Loads and merges sort a full file's rows a task, so a task's memory does not grow with the table.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slateql.errors import ExecutionError
from slateql.functions import literals
from slateql.functions.predicates import column, compile_where, find, holds, may_hold, pins
from slateql.plans import syntax
from slateql.sources.external import External
from slateql.sources.snapshots import DataFile, Store, Table

MOST_COLUMNS = 255
#: Bytes of a full data file, and its rows where these are small or compress well.
TARGET, MOST_ROWS = 128 << 20, 1 << 20
#: A row takes about so many times its bytes in a file while it is sorted, where a column takes ``_CELL`` bytes and a text its length besides.
_PACKED, _CELL = 4, 8
#: So many small files of a size are merged into one.
FAN = 16
_LEAST_TIER = 4 << 10


def quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def select(s: syntax.Select, table: Table | External, rows: DataFrame) -> DataFrame:
    """Filtered, in key order, projected to the declared names."""
    names = table.schema.names
    if s.columns is not None:
        fields = [find(c, table.schema) for c in s.columns]
        for c, f in zip(s.columns, fields):
            if f is None:
                raise ExecutionError(f"column {quoted(c)} not found in table {quoted(s.table)}")
        names = [f.name for f in fields]
    where = compile_where(s.where, table.schema)
    out = rows if where is None else rows.where(where)
    if table.key is not None and not pins(s.where, table.schema, table.key):
        out = out.orderBy(column(table.key))
    return out.select(*[column(n).alias(n) for n in names])


def new_row(s: syntax.Insert, table: Table) -> tuple[int, tuple]:
    """The key and the row of an INSERT, checked in the dialect's order as far as no data is needed."""
    if table.key_type != "INT":
        raise ExecutionError(f"primary key {quoted(table.key)} has unsupported type {quoted(table.key_type)}: only INT is supported")
    if len(s.values) != len(table.schema.fields):
        raise ExecutionError(f"mismatched value count ({len(s.values)} vs {len(table.schema.fields)})")
    if len(table.schema.fields) - 1 > MOST_COLUMNS:
        raise ExecutionError(f"table {quoted(s.table)} has too many columns ({len(table.schema.fields) - 1}); maximum is {MOST_COLUMNS}")
    return literals.primary_key(s.values[0]), s.values


def typed_row(values: tuple, table: Table) -> tuple:
    out = []
    for k, (v, f) in enumerate(zip(values, table.schema.fields)):
        try:
            out.append(literals.value(v, f.dataType))
        except ExecutionError as e:
            raise ExecutionError(f"column {quoted(f.name)}: {e}" if k else f"primary key: {e}") from None
    return tuple(out)


def in_range(table: Table, where: syntax.Predicate | None) -> tuple[DataFile, ...]:
    """The files that may hold a row for ``where``, by their key ranges."""
    return tuple(f for f in table.files if may_hold(where, table.schema, f.low, f.high))


def has_key(store: Store, table: Table, key: int) -> bool:
    if any(r[0] == key for r in table.pending):
        return True
    files = tuple(f for f in table.files if f.low <= key <= f.high)
    return bool(files) and not store.read(table, files, pending=False).where(column(table.key) == key).limit(1).isEmpty()


def insert(s: syntax.Insert, table: Table, store: Store) -> Table:
    """The table with the row pending; it is written when the transaction commits."""
    key, values = new_row(s, table)
    if has_key(store, table, key):
        raise ExecutionError(f"duplicate key: primary key {key} already exists in table {quoted(s.table)}")
    return replace(table, pending=(*table.pending, typed_row(values, table)))


def flushed(table: Table, store: Store) -> Table:
    """Pending rows written as one file."""
    if not table.pending:
        return table
    return replace(table, files=table.files + store.write_rows(list(table.pending), table), pending=())


def _touched(table: Table, store: Store, where: syntax.Predicate | None) -> tuple[DataFile, ...]:
    """The files that hold a matching row; their number is bounded by the table's files."""
    files = in_range(table, where)
    if where is None or not files:
        return files
    rows = store.read(table, files).where(compile_where(where, table.schema)).select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    found = {store.relative(r.f) for r in rows}
    return tuple(f for f in files if f.path in found)


def _rewritten(table: Table, store: Store, where: syntax.Predicate | None, change) -> Table:
    table = flushed(table, store)
    touched = _touched(table, store, where)
    if not touched:
        return table
    kept = tuple(f for f in table.files if f not in set(touched))
    return replace(table, files=kept + store.write(change(store.read(table, touched)), table))


def update(s: syntax.Update, table: Table, store: Store) -> Table:
    field = find(s.column, T.StructType(table.schema.fields[1:]))
    if find(s.column, T.StructType(table.schema.fields[:1])) is not None or field is None:
        raise ExecutionError(f"unable to find column {quoted(s.column)} in schema")
    if not literals.matches(s.value, field.dataType):
        raise ExecutionError("datatype do not match")
    try:
        new = F.lit(literals.value(s.value, field.dataType)).cast(field.dataType)
    except ExecutionError:  # an integer out of range fails only if a row would take it
        where = compile_where(s.where, table.schema)
        rows = store.read(table)
        if not (rows if where is None else rows.where(where)).isEmpty():
            raise
        return table
    changed = F.when(holds(s.where, table.schema), new).otherwise(column(field.name))
    return _rewritten(table, store, s.where, lambda rows: rows.withColumn(field.name, changed))


def delete(s: syntax.Delete, table: Table, store: Store) -> Table:
    if s.where is None:
        return replace(table, files=(), pending=())
    return _rewritten(table, store, s.where, lambda rows: rows.where(~holds(s.where, table.schema)))


def _weight(table: Table, rows: int, size: int) -> int:
    """``size`` bytes of Parquet, or more where the rows count for more: a full file weighs ``TARGET``."""
    return max(size, rows * TARGET // MOST_ROWS, rows * len(table.schema.fields) * _CELL // _PACKED)


def _ordered(rows: DataFrame, key: Column, weight: int) -> DataFrame:
    """``rows`` in key order, in partitions of disjoint ranges and about the weight of a full file."""
    n = math.ceil(weight / TARGET)
    return (rows.repartitionByRange(n, key) if n > 1 else rows.coalesce(1)).sortWithinPartitions(key)


def _measured(rows: DataFrame, table: Table) -> int:
    """About what ``rows`` weigh, by one pass that counts rows and bytes of text."""
    texts = [F.coalesce(F.octet_length(column(f.name)), F.lit(0)) for f in table.schema.fields if isinstance(f.dataType, T.StringType)]
    found = rows.agg(F.count("*").alias("n"), F.sum(sum(texts, F.lit(0)).cast("long")).alias("text")).first()
    return _weight(table, found.n, (found.n * len(table.schema.fields) * _CELL + (found.text or 0)) // _PACKED)


def load(df: DataFrame, table: Table, store: Store) -> Table:
    """Bulk load (an extension): rows are written in key order and checked for key type, range and uniqueness.

    Equal keys are neighbours where they are written, and are seen there. Keys are then compared with those of the older files
    whose ranges they reach into. The input is evaluated to measure it and to write it, and for samples of its keys if it fills several files.
    """
    wrong = ExecutionError(f"keys of table {quoted(table.name)} must be integers from 0 to {literals.MOST_KEY}")
    if table.key_type != "INT":
        raise wrong
    key, table = column(table.key), flushed(table, store)
    rows = df.select(*[column(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields])
    weight = _measured(rows, table)
    alike, seen = "n" * (1 + max(map(len, rows.columns))), Observation()  # a name that no column has
    ordered = _ordered(rows if weight > TARGET else rows.repartition(1), key, weight).withColumn(alike, F.count("*").over(Window.partitionBy(key)))
    checked = ordered.observe(seen, F.min(F.when(F.col(alike) > 1, key)).alias("twice")).drop(alike)
    try:
        new = store.write(checked, table)
    except ExecutionError:
        raise wrong from None
    if any(f.low < 0 or f.high > literals.MOST_KEY for f in new):
        raise wrong
    if not new:
        return table
    twice = seen.get["twice"]
    near = tuple(f for f in table.files if any(f.low <= g.high and g.low <= f.high for g in new))
    if twice is None and near:
        keys = store.read(table, new, pending=False).select(key.alias("k"))
        found = store.read(table, near, pending=False).select(key.alias("k")).join(keys, "k", "left_semi").first()
        twice = found and found.k
    if twice is not None:
        raise ExecutionError(f"duplicate key: primary key {twice} already exists in table {quoted(table.name)}")
    return replace(table, files=table.files + new)


def _small(table: Table) -> list[DataFile]:
    return [f for f in table.files if f.bytes < TARGET // 2 and _weight(table, f.rows, f.bytes) < TARGET // 2]


def _tier(weight: int) -> int:
    return max(0, int(math.log(max(1, weight / _LEAST_TIER), 4)))


def _merged(table: Table, store: Store, files: list[DataFile]) -> Table:
    weight = _weight(table, sum(f.rows for f in files), sum(f.bytes for f in files))
    rows = _ordered(store.read(table, tuple(files), pending=False), column(table.key), weight)
    kept = tuple(f for f in table.files if f not in set(files))
    return replace(table, files=kept + store.write(rows, table))


def merged(table: Table, store: Store) -> Table:
    """The table after the merge that is due, if any: of the smallest tier with ``FAN`` files, and what is smaller."""
    tiers = {f: _tier(_weight(table, f.rows, f.bytes)) for f in _small(table)}
    counts = Counter(tiers.values())
    due = min((t for t, n in counts.items() if n >= FAN), default=None)
    return table if due is None else _merged(table, store, [f for f, t in tiers.items() if t <= due])


def compacted(table: Table, store: Store) -> Table:
    """All small files as few of disjoint key ranges; full ones stay."""
    table = flushed(table, store)
    small = _small(table)
    return _merged(table, store, small) if len(small) > 1 else table
