"""The engine: catalog, transactions and statements.

Reads see an immutable snapshot and take no lock. UPDATE, DELETE and bulk loads take their table's
exclusive lock until their transaction ends; INSERT takes its key's exclusive and its table's shared lock, so transactions that insert
different keys go on side by side and their rows are added to whatever was committed meanwhile. A transaction begins with what any process published before. Of two processes that change one table at a time the
later to commit gets a ``ConflictError``. DDL publishes at once and is not undone by a rollback. A transaction sees
its own writes; its commit publishes all its tables in one manifest.
"""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from slateql.errors import ConflictError, ExecutionError, VersionTaken
from slateql.functions.literals import SPARK_TYPES, ascii_upper, type_name
from slateql.locks import EXCLUSIVE, SHARED, LockManager
from slateql.operators import statements
from slateql.operators.statements import quoted
from slateql.plans import syntax
from slateql.plans.parser import parse_sql
from slateql.sources.external import External
from slateql.sources.snapshots import Manifest, Store, Table

#: How often a change is tried again on what other processes published meanwhile.
TRIES = 20


class Transaction:
    """Statements against one base manifest and the tables written so far."""

    def __init__(self, engine: Engine, number: int):
        self.engine, self.id, self.status = engine, number, "active"
        self.base = engine.refreshed()
        self.staged: dict[str, Table] = {}
        self.locked: dict[str, Table] = {}  # staged tables as they were when they were locked
        self.exclusive: set[str] = set()  # those of which all rows are locked; of the others only pending rows are staged

    def sql(self, text: str) -> DataFrame | None:
        return self.execute(parse_sql(text, self.engine.strict))

    def table(self, name: str) -> Table:
        found = self.staged.get(name) or self.base.tables.get(name)
        if found is None:
            raise ExecutionError(f"table {quoted(name)} not found")
        return found

    def _for_write(self, name: str, key: int | None = None) -> Table:
        """The latest state of a table with what this transaction changed, locked for all rows or for ``key``.

        A table locked before for keys alone may have been changed by others; the rows pending here are put on its latest state.
        """
        if name in self.engine.external:
            raise ExecutionError(f"table {quoted(name)} is read-only")
        self.table(name)
        if name in self.exclusive:
            return self.staged[name]
        self.engine.locks.lock(self.id, name, EXCLUSIVE if key is None else SHARED)
        if key is not None:
            self.engine.locks.lock(self.id, (name, key), EXCLUSIVE)
        now = self.engine.refreshed()
        self.base = self.base if self.staged else now
        latest = now.tables.get(name)
        if latest is None:
            raise ExecutionError(f"table {quoted(name)} not found")
        self.staged[name] = replace(latest, pending=self.staged[name].pending if name in self.staged else ())
        self.locked[name] = latest
        if key is None:
            self.exclusive.add(name)
        return self.staged[name]

    def execute(self, s: syntax.Statement) -> DataFrame | None:
        if self.status != "active":
            raise ExecutionError(f"transaction {self.id} is {self.status}")
        store = self.engine.store
        if isinstance(s, syntax.Select):
            if s.table in self.engine.external:
                source = self.engine.external[s.table]
                return statements.select(s, source, source.read(store.spark))
            table = self.table(s.table)
            return statements.select(s, table, store.read(table, statements.in_range(table, s.where)))
        if isinstance(s, syntax.CreateTable):
            self.engine.create(s)
            self.base = replace(self.base, tables={**self.base.tables, s.table: self.engine.manifest.tables[s.table]})
            return None
        if isinstance(s, syntax.DropTable):
            self.engine.drop(s.table, self.id)
            self.base = self.base.without(s.table)
            self.staged.pop(s.table, None)
            self.locked.pop(s.table, None)
            self.exclusive.discard(s.table)
            return None
        if isinstance(s, syntax.Insert):
            key = 0 if s.table in self.engine.external else statements.new_row(s, self.table(s.table))[0]
            self.staged[s.table] = statements.insert(s, self._for_write(s.table, key), store)
            return None
        change = {syntax.Update: statements.update, syntax.Delete: statements.delete}[type(s)]
        self.staged[s.table] = change(s, self._for_write(s.table), store)
        return None

    def load(self, name: str, df: DataFrame) -> None:
        table = self._for_write(name)
        self.staged[name] = statements.load(df, table, self.engine.store)

    def commit(self) -> None:
        if self.status == "active":
            try:
                self.engine.publish(self.staged, self.locked, self.exclusive)
                self.status = "committed"
            finally:
                if self.status == "active":
                    self.status = "rolled back"
                self.engine.locks.unlock_all(self.id)

    def rollback(self) -> None:
        """Staged files are simply not named by any manifest; ``vacuum`` removes them."""
        if self.status == "active":
            self.status, self.staged = "rolled back", {}
            self.engine.locks.unlock_all(self.id)


class Engine:
    def __init__(self, spark: SparkSession, root: str, strict: bool = True):
        self.store, self.strict = Store(spark, root), strict
        self.manifest: Manifest = self.store.load()
        self.external: dict[str, External] = {}
        self.locks = LockManager()
        self._publishing = threading.Lock()
        self._numbers = itertools.count(1)
        self._transactions: dict[int, Transaction] = {}

    # --- statements and transactions

    def sql(self, text: str) -> DataFrame | None:
        """One statement in a transaction of its own: a DataFrame for SELECT, None for the others."""
        return self.execute(parse_sql(text, self.strict))

    def execute(self, s: syntax.Statement) -> DataFrame | None:
        txn = self.begin()
        try:
            out = txn.execute(s)
        except BaseException:
            self.rollback(txn.id)
            raise
        self.commit(txn.id)
        return out

    def begin(self) -> Transaction:
        txn = Transaction(self, next(self._numbers))
        self._transactions[txn.id] = txn
        return txn

    def commit(self, number: int) -> None:
        """Unknown and ended transactions are ignored, as by ``rollback``."""
        txn = self._transactions.pop(number, None)
        if txn:
            txn.commit()

    def rollback(self, number: int) -> None:
        txn = self._transactions.pop(number, None)
        if txn:
            txn.rollback()

    def refreshed(self) -> Manifest:
        """The latest manifest, whichever process published it."""
        with self._publishing:
            if self.store.newer(self.manifest.version):
                self.manifest = self.store.load()
            return self.manifest

    def _change(self, change: Callable[[Manifest], Manifest]) -> None:
        """Publishes ``change`` of the latest manifest, again if another process was first."""
        for _ in range(TRIES):
            now = self.refreshed()
            with self._publishing:
                if self.manifest is not now:
                    continue
                after = change(now)
                if after is now:
                    return
                try:
                    self.manifest = self.store.publish(after)
                    return
                except VersionTaken:
                    pass
        raise ConflictError(f"other processes published {TRIES} times in between")

    def publish(self, staged: dict[str, Table], locked: dict[str, Table], exclusive: set[str]) -> None:
        done = {name: statements.flushed(table, self.store) for name, table in staged.items()}

        def change(now: Manifest) -> Manifest:
            for name, table in done.items():
                latest = now.tables.get(name)
                if latest is None or latest.table_id != table.table_id:
                    continue  # dropped meanwhile
                if name not in exclusive:
                    table = self._added(staged[name], table, locked[name], latest)
                elif not latest.same(locked[name]):
                    raise ConflictError(f"table {quoted(name)} was changed by another process")
                if not latest.same(table):
                    now = now.with_table(statements.merged(table, self.store))
            return now

        self._change(change)

    def _added(self, staged: Table, flushed: Table, locked: Table, latest: Table) -> Table:
        """``latest`` with the rows inserted; another process may have inserted a key of theirs meanwhile."""
        added = tuple(f for f in flushed.files if f not in set(staged.files))
        since = tuple(f for f in latest.files if f not in set(locked.files))
        for key in sorted(r[0] for r in staged.pending):
            if statements.has_key(self.store, replace(latest, files=since), key):
                raise ConflictError(f"primary key {key} was inserted into table {quoted(latest.name)} by another process")
        return replace(latest, files=latest.files + added)

    # --- catalog

    def schema(self, name: str) -> T.StructType | None:
        found = self.manifest.tables.get(name) or self.external.get(name)
        return found.schema if found else None

    def next_table_id(self) -> int:
        return self.manifest.next_id

    def create(self, s: syntax.CreateTable) -> None:
        names = [ascii_upper(n) for n, _ in s.columns]
        fields = [T.StructField(n, SPARK_TYPES[k], True) for n, k in s.columns]

        def change(now: Manifest) -> Manifest:
            if s.table in now.tables or s.table in self.external:
                raise ExecutionError(f"table {quoted(s.table)} already exists")
            if len(set(names)) < len(names):
                raise ExecutionError(f"table {quoted(s.table)} has a column twice")
            table = Table(now.next_id, s.table, T.StructType(fields), s.columns[0][1])
            return replace(now.with_table(table), next_id=now.next_id + 1)

        self._change(change)

    def drop(self, name: str, txn: int) -> None:
        def known(now: Manifest) -> Manifest:
            if name not in now.tables:
                raise ExecutionError(f"table {quoted(name)} does not exist")
            return now

        known(self.refreshed())
        self.locks.lock(txn, name, EXCLUSIVE)
        self._change(lambda now: known(now).without(name))

    def register(self, name: str, path: str, key: str | None = None) -> None:
        """A read-only Parquet table."""
        if name in self.refreshed().tables:
            raise ExecutionError(f"table {quoted(name)} already exists")
        self.external[name] = External.open(self.store.spark, name, path, key)

    def load(self, name: str, df: DataFrame) -> None:
        """Bulk insert."""
        txn = self.begin()
        try:
            txn.load(name, df)
        except BaseException:
            self.rollback(txn.id)
            raise
        self.commit(txn.id)

    def create_from(self, name: str, df: DataFrame, key: str) -> None:
        """A managed table of a DataFrame with integer, text and boolean columns, ``key`` first."""
        columns = [key, *[c for c in df.columns if c != key]]
        self.create(syntax.CreateTable(name, tuple((c, type_name(df.schema[c].dataType)) for c in columns)))
        self.load(name, df)

    def compact(self, name: str) -> None:
        txn = self.begin()
        try:
            table = txn._for_write(name)
            txn.staged[name] = statements.compacted(table, self.store)
        except BaseException:
            self.rollback(txn.id)
            raise
        self.commit(txn.id)

    def vacuum(self, keep: int = 1) -> int:
        """Removes files that the last ``keep`` manifests do not name; DataFrames over older ones stop working."""
        return self.store.vacuum(keep)
