import os
from types import SimpleNamespace

import pytest

from poolscope.plans import storage


def test_cluster_needs_the_setting():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    named = {}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named.get(key, default)), sparkContext=context)
    with pytest.raises(storage.SharedFolderMissing):
        storage.shared_folder(session)
    named[storage.SETTING] = "hdfs:///shared/"
    assert storage.shared_folder(session) == "hdfs:///shared"


def test_written_tables_are_removed(spark):
    storage.release(spark)
    table = storage.stored(spark.range(5), "t")
    (path,) = (p for _, p in storage._handed_out)
    local = path.removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(local)
    assert storage.release(spark) == 1 and not os.path.exists(local)
