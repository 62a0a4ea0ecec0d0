import os
import time
from types import SimpleNamespace

import pytest

from slateql.errors import ExecutionError
from slateql.sources import shared


def test_folders_are_made_and_removed(spark):
    folder = shared.new_folder(spark, "engine")
    spark.range(3).write.parquet(f"{folder}/data")
    assert folder.startswith(shared.shared_folder(spark)) and spark.read.parquet(f"{folder}/data").count() == 3
    shared.remove_folders(spark)
    assert os.path.exists(folder)  # it is not a day old
    assert shared.remove_folders(spark, 0) >= 1
    assert not os.path.exists(folder)
    other = shared.new_folder(spark, "pipeline_x")
    spark.range(1).write.parquet(other)
    shared.remove(spark, other)
    assert not os.path.exists(other) and shared.remove_folders(spark, 0) == 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    conf = SimpleNamespace(get=lambda name, default: default)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ExecutionError, match="spark.checkpoint.dir"):
            shared.shared_folder(session(master))
    made = shared.shared_folder(session("local[4]"))
    assert os.path.isdir(made) and time.time() - os.stat(made).st_mtime < 60
    os.rmdir(made)
