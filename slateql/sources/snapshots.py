"""Managed tables as immutable Parquet files, named by manifests.

    root/catalog/manifest-000000017.json   the catalog as of version 17; the highest number holds
    root/catalog/files-<uuid>.json         some of a table's files
    root/data/<table id>/<uuid>/part-*.parquet

The catalog holds each file's rows, bytes and key range, so that a statement reads the files that its keys may lie in
and no other, and only small files are ever merged. A manifest names lists of files; a commit writes the lists anew that it
changes, so a small change of a table of many files is a small write. A manifest is written aside and renamed to its number, which fails if another
process took the number first (optimistic concurrency). Data files never
change: a DataFrame over an old manifest keeps reading the same files until
``vacuum`` removes what no manifest of the last ``keep`` versions names. All file access goes through Hadoop's file
systems, so a root may lie on any shared store that Spark reaches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import astuple, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slateql.errors import ExecutionError, VersionTaken


@dataclass(frozen=True)
class DataFile:
    """A data file, its rows and bytes, and the range of its keys."""

    path: str
    rows: int
    bytes: int
    low: int
    high: int


@dataclass(frozen=True)
class Table:
    """A table's state: its files, and rows that a transaction has not written yet."""

    table_id: int
    name: str
    schema: T.StructType
    key_type: str
    files: tuple[DataFile, ...] = ()
    pending: tuple[tuple, ...] = ()

    @property
    def key(self) -> str:
        return self.schema.fields[0].name

    def same(self, other: Table) -> bool:
        """Whether two states of a table hold the same files, in whatever order."""
        return self.table_id == other.table_id and self.pending == other.pending and (self.files is other.files or set(self.files) == set(other.files))


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_id: int = 1
    tables: dict[str, Table] = field(default_factory=dict)

    def with_table(self, table: Table) -> Manifest:
        return replace(self, tables={**self.tables, table.name: table})

    def without(self, name: str) -> Manifest:
        return replace(self, tables={n: t for n, t in self.tables.items() if n != name})


#: Files of a list, and lists below half of that before they are joined.
LIST_FILES, SMALL_LISTS = 1_000, 16


def _table(name: str, raw: dict, files_of: Callable[[str], tuple[DataFile, ...]]) -> Table:
    try:
        schema = T.StructType.fromJson(raw["schema"])
        if not schema.fields or not isinstance(raw["id"], int) or raw["key_type"] not in ("INT", "TEXT", "BOOL"):
            raise ValueError("no column, no id or no key type")
        return Table(raw["id"], name, schema, raw["key_type"], tuple(f for part in raw["lists"] for f in files_of(str(part))))
    except (KeyError, TypeError, ValueError) as e:
        raise ExecutionError(f"malformed catalog entry for table {json.dumps(name)}: {e}") from None


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, jvm = spark, spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        top = self._path(root)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = top.getFileSystem(conf)
        self.root = self.fs.makeQualified(top).toString()
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._bytes = jvm.org.apache.commons.io.IOUtils
        self._lists: dict[str, tuple[DataFile, ...]] = {}  # those of the manifest loaded or published last
        self._lists_of: dict[int, tuple[str, ...]] = {}  # table id -> its lists there
        self.fs.mkdirs(self._at("catalog"))
        self.fs.mkdirs(self._at("data"))

    def _at(self, *parts: str):
        return self._path("/".join([self.root, *parts]))

    def _names(self, *parts: str) -> list[str]:
        at = self._at(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    # --- manifests

    def versions(self) -> list[int]:
        return [int(n[9:-5]) for n in self._names("catalog") if n.startswith("manifest-") and n.endswith(".json")]

    def load(self, version: int | None = None) -> Manifest:
        """The manifest of a version, by default the latest; empty for a new root."""
        found = self.versions()
        if not found:
            return Manifest()
        version = max(found) if version is None else version
        raw = self._json(self._manifest(version))
        tables = {n: _table(n, t, self._files_of) for n, t in raw["tables"].items()}
        self._keep({t["id"]: tuple(t["lists"]) for t in raw["tables"].values()})
        return Manifest(raw["version"], raw["next_id"], tables)

    def _json(self, path):
        stream = self.fs.open(path)
        try:
            return json.loads(self._bytes.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write_json(self, path, content) -> None:
        stream = self.fs.create(path, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.hsync()
        stream.close()

    def _files_of(self, name: str) -> tuple[DataFile, ...]:
        if name not in self._lists:
            self._lists[name] = tuple(DataFile(str(f[0]), *map(int, f[1:])) for f in self._json(self._at("catalog", name)))
        return self._lists[name]

    def _keep(self, lists_of: dict[int, tuple[str, ...]]) -> None:
        self._lists_of = lists_of
        named = {name for lists in lists_of.values() for name in lists}
        self._lists = {name: files for name, files in self._lists.items() if name in named}

    def _listed(self, table: Table) -> tuple[str, ...]:
        """Names of lists that together hold the table's files: those of before that still hold, and new ones for the rest."""
        left = set(table.files)
        kept = [name for name in self._lists_of.get(table.table_id, ()) if left.issuperset(self._files_of(name))]
        small = [name for name in kept if len(self._files_of(name)) < LIST_FILES // 2]
        if len(small) > SMALL_LISTS:
            kept = [name for name in kept if name not in set(small)]
        left.difference_update(*map(self._files_of, kept))
        rest = [f for f in table.files if f in left]
        for k in range(0, len(rest), LIST_FILES):
            name = f"files-{uuid.uuid4()}.json"
            self._write_json(self._at("catalog", name), [list(astuple(f)) for f in rest[k : k + LIST_FILES]])
            self._lists[name] = tuple(rest[k : k + LIST_FILES])
            kept.append(name)
        return tuple(kept)

    def newer(self, version: int) -> bool:
        """Whether another process published since; its vacuum may have removed the versions between."""
        exists = lambda v: self.fs.exists(self._manifest(v))
        return exists(version + 1) or (version > 0 and not exists(version))

    def _manifest(self, version: int):
        return self._at("catalog", f"manifest-{version:09d}.json")

    def publish(self, manifest: Manifest) -> Manifest:
        """Writes the next version; durable and visible when this returns."""
        manifest = replace(manifest, version=manifest.version + 1)
        lists = {t.table_id: self._listed(t) for t in manifest.tables.values()}
        tables = {n: {"id": t.table_id, "key_type": t.key_type, "schema": t.schema.jsonValue(), "lists": list(lists[t.table_id])} for n, t in manifest.tables.items()}
        aside = self._at("catalog", f".{uuid.uuid4()}.tmp")
        self._write_json(aside, {"version": manifest.version, "next_id": manifest.next_id, "tables": tables})
        try:
            self._files.rename(aside, self._manifest(manifest.version), self._no_options)
        except Exception as e:
            self.fs.delete(aside, False)
            if self.fs.exists(self._manifest(manifest.version)):
                raise VersionTaken(f"version {manifest.version} was published by another process") from e
            raise
        self._keep(lists)
        return manifest

    # --- data

    def write(self, df: DataFrame, table: Table) -> tuple[DataFile, ...]:
        """Writes rows as new files of a table. One pass over the written keys says what they hold; empty files are not named."""
        part = f"{table.table_id}/{uuid.uuid4()}"
        target = "/".join([self.root, "data", part])
        df.write.parquet(target)
        sizes = {f"data/{part}/{s.getPath().getName()}": s.getLen() for s in self.fs.listStatus(self._at("data", part))}
        key = F.col("`" + table.key.replace("`", "``") + "`")
        keys = self.spark.read.schema(T.StructType(table.schema.fields[:1])).parquet(target).groupBy(F.col("_metadata.file_path").alias("f"))
        found = keys.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("keys")).collect()  # a row per new file
        if any(r.keys < r.n for r in found):
            raise ExecutionError(f"table {json.dumps(table.name)}: a primary key is null")
        made = [DataFile(self.relative(r.f), r.n, sizes[self.relative(r.f)], r.low, r.high) for r in found]
        return tuple(sorted(made, key=lambda f: (f.low, f.path)))

    def write_rows(self, rows: list[tuple], table: Table) -> tuple[DataFile, ...]:
        """The same for rows of the driver's, as one file."""
        part = f"{table.table_id}/{uuid.uuid4()}"
        self.spark.createDataFrame(sorted(rows), table.schema).coalesce(1).write.parquet("/".join([self.root, "data", part]))
        (name,) = [n for n in self._names("data", *part.split("/")) if n.startswith("part-")]
        size = self.fs.getFileStatus(self._at("data", part, name)).getLen()
        return (DataFile(f"data/{part}/{name}", len(rows), size, min(r[0] for r in rows), max(r[0] for r in rows)),)

    def paths(self, files) -> list[str]:
        return ["/".join([self.root, f.path]) for f in files]

    def relative(self, path: str) -> str:
        """A file's name in manifests, from the path that Spark reports."""
        return path[path.rindex("/data/") + 1 :]

    def read(self, table: Table, files: tuple[DataFile, ...] | None = None, pending: bool = True) -> DataFrame:
        """Rows in no order: of all files or those named, and the pending ones."""
        files = table.files if files is None else files
        out = self.spark.read.schema(table.schema).parquet(*self.paths(files)) if files else None
        if out is None or (pending and table.pending):
            rows = self.spark.createDataFrame(list(table.pending) if pending else [], table.schema)
            out = rows if out is None else out.unionByName(rows)
        return out

    def vacuum(self, keep: int = 1) -> int:
        """Removes manifests but the last ``keep``, and lists and data files that none of these names; how many data files went."""
        versions = sorted(self.versions())
        kept = versions[-max(1, keep) :]
        raw = [self._json(self._manifest(v)) for v in kept]
        lists = {name for m in raw for t in m["tables"].values() for name in t["lists"]}
        named = {f.path for name in lists for f in self._files_of(name)}
        for v in versions[: -len(kept)] if kept else []:
            self.fs.delete(self._manifest(v), False)
        for name in self._names("catalog"):
            if name.startswith("files-") and name not in lists:
                self.fs.delete(self._at("catalog", name), False)
        gone = 0
        for table_id in self._names("data"):
            for part in self._names("data", table_id):
                files = [f"data/{table_id}/{part}/{n}" for n in self._names("data", table_id, part) if n.startswith("part-")]
                for f in files:
                    if f not in named:
                        self.fs.delete(self._at(f), False)
                        gone += 1
                if not named.intersection(files):
                    self.fs.delete(self._at("data", table_id, part), True)
        return gone
