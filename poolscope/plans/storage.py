"""Written intermediate tables on shared storage.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local
session may leave it unset; its tables then go beside the warehouse. Every path
handed out is remembered and removed by ``release`` or when the driver ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_handed_out: list[tuple[SparkSession, str]] = []


class SharedFolderMissing(RuntimeError):
    """No folder that all executors see is known."""


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables; raises where a cluster names none."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master or ""
    if master != "local" and not master.startswith("local["):
        raise SharedFolderMissing(f"set {SETTING} to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_runs"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/poolscope/{label}-{uuid.uuid4().hex}"
    _handed_out.append((spark, path))
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, cutting the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove what this driver wrote for finished runs; returns the number of paths.

    Call it when the results of the runs have been written or are no longer needed.
    """
    mine = [path for _, path in _handed_out]
    _handed_out.clear()
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in mine:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(mine)


@atexit.register
def _release_at_exit() -> None:
    if _handed_out:
        spark = _handed_out[-1][0]
        if spark.sparkContext._jsc is not None:
            release(spark)
