"""The cluster's shared folder for intermediate data.

``spark.checkpoint.dir`` names it. Where the setting is missing, a local session gets
a folder of its own; on a cluster, where executors would not see each other's files, that
is an error. Folders made here are removed by ``remove_folders``; the files of ``checkpoint()`` by
Spark itself, with ``spark.cleaner.referenceTracking.cleanCheckpoints`` set to true.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import SparkSession

from slateql.errors import ExecutionError

_PREFIX = "slateql-"


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    found, used = spark.conf.get("spark.checkpoint.dir", None), context.getCheckpointDir()
    if found is None and used is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ExecutionError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="slateql-checkpoint-")
    if used is None:
        context.setCheckpointDir(found)
    return (found or used).rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """The path of a fresh folder under the shared one; its name says when it was made."""
    return f"{shared_folder(spark)}/{_PREFIX}{kind}-{int(time.time())}-{uuid.uuid4()}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_folders(spark: SparkSession, older_than_s: float = 86_400) -> int:
    """Removes what ``new_folder`` named that long ago or earlier; DataFrames over it stop working. How many went."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    until, gone = time.time() - older_than_s, 0
    for name in names:
        parts = name.split("-")
        if name.startswith(_PREFIX) and len(parts) > 3 and parts[2].isdigit() and int(parts[2]) <= until:
            remove(spark, f"{shared_folder(spark)}/{name}")
            gone += 1
    return gone
