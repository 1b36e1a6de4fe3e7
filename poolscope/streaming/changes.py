"""Change events and issue merging over arriving data."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from poolscope.functions.versions import version_key
from poolscope.operators.lifecycle import Scope, merge_issues, one_per_key
from poolscope.plans.commits import Committed
from poolscope.plans.storage import stored
from poolscope.schemas import DDL

# Workers get these functions with the task and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGE = DDL["change_events"]


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKSDB) -> Iterator[None]:
    """Queries started inside keep their state in this store; the session's setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, provider)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def leading(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows above all earlier ones of their package and repository, and the replaced ones.

    Any other row is at most an old or repeated version, whatever rows are elsewhere.
    """
    rows = rows.sort_values("_order", kind="stable")
    _, rank = np.unique(rows["_vk"] + "\0" + rows["version"].fillna(""), return_inverse=True)
    ranks = pd.Series(rank, index=rows.index)
    upto = ranks.groupby([rows["package"], rows["repo"]], dropna=False).cummax()
    above = upto.groupby([rows["package"], rows["repo"]], dropna=False).shift(fill_value=-1)
    return rows[(ranks > above) | rows["_replaced"]]


class GreatestVersion(StatefulProcessor):
    """State of a (package, repository): its greatest version so far."""

    def init(self, handle) -> None:
        self.top = handle.getValueState("top", "vk string, version string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        before = self.top.get() if self.top.exists() else None
        top = before and tuple(before)
        for r in sorted(rows, key=lambda r: r["_order"]):
            version = (r["_vk"], r["version"])
            change = None
            if r["_replaced"]:
                change = ("overwrite", r["version"])
            elif top is None:
                change = ("new", "")
            elif version > top:
                change = ("upgrade", top[1])
            if change and r["_readable"]:
                yield Row(comp=r["_comp"], pkg=r["package"], arch=r["architecture"], method=change[0], from_ver=change[1], to_ver=r["version"])
            top = version if top is None else max(top, version)
        if top != (before and tuple(before)):
            self.top.update(top)

    def close(self) -> None:
        pass


def change_stream(arrivals: DataFrame, order: str) -> DataFrame:
    """Change events of arriving package rows, as a streaming table.

    The greatest version per (package, repo) is keyed state in Spark's state store, so a
    batch reads and writes only the keys it saw. Each task passes on only rows that lead among those
    it read, so a busy package costs its events and a few rows per task. Rows without a version are
    left out. Within a batch ``order`` tells what came first.
    """
    names = arrivals.columns
    replaced = F.coalesce("replaced", F.lit(False)) if "replaced" in names else F.lit(False)
    readable = F.col("debtime").isNotNull() if "debtime" in names else F.lit(True)
    rows = arrivals.filter("version is not null").select(
        "package", "repo", "version", "architecture", F.concat_ws("-", "branch", "component").alias("_comp"),
        F.col(order).alias("_order"), version_key(F.col("version")).alias("_vk"),
        replaced.alias("_replaced"), readable.alias("_readable"),
    )

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (leading(b) for b in batches if len(b))

    return rows.mapInPandas(lead, rows.schema).groupBy("package", "repo").transformWithState(
        GreatestVersion(), CHANGE, "Append", "None"
    )


def stream_changes(arrivals: DataFrame, target: str, order: str) -> StreamingQuery:
    """Publish new, upgraded and replaced packages from arriving package rows.

    Events go to ``target/events``, a folder of Parquet files that Spark's file sink commits batch
    by batch; a query started again on the same target goes on with the state it left.
    """
    with state_store(arrivals.sparkSession):
        return (
            change_stream(arrivals, order).writeStream.format("parquet")
            .option("path", f"{target}/events").option("checkpointLocation", f"{target}/checkpoint")
            .trigger(availableNow=True).start()
        )


def issue_table(spark: SparkSession, path: str, buckets: int = 64) -> Committed:
    """The issues as a committed table, in buckets of packages."""
    return Committed(spark, path, spark.createDataFrame([], DDL["issues"]).schema, ("package",), buckets)


def merge_batch(
    table: Committed, rows: DataFrame, found: DataFrame, now: Column, scope: Scope, writer: str, batch: int
) -> None:
    """Merge the findings on changed packages into the issue table, once per batch number.

    Only buckets that hold a changed or a found package are read and replaced; with numbers
    over all rows (``scope.whole``) it is every bucket. A finding on a package that did not
    arrive meets that package's issues there and keeps its times.
    """
    if table.done(writer, batch):
        return
    read = table.snapshot()
    found = stored(one_per_key(found), "batch-findings")
    buckets = range(table.buckets)
    if not scope.whole:
        named = rows.select("package").unionByName(found.select("package"))
        buckets = [r[0] for r in named.select(table.bucket_of("package")).distinct().collect()]
    merged = merge_issues(table.at(read, buckets), found, rows, now, scope)
    table.replace(merged, buckets, writer, batch, read)


def stream_snapshot_merge(
    packages: DataFrame, table: Committed, detect: Callable[[DataFrame], DataFrame],
    now: Callable[[int], Column], checkpoint: str, scope: Scope, writer: str = "stream",
) -> StreamingQuery:
    """Incremental analysis: merge the findings on each batch of changed packages.

    ``detect`` gives the findings on the arrived rows; ``scope`` says for which numbers an
    issue that was not found again is retired. ``now`` gives the time of a batch. A batch is
    one commit of ``table``: one that fails leaves the table as it was, one that
    runs again after its commit changes nothing.
    """

    def one_batch(rows: DataFrame, batch: int) -> None:
        if not table.done(writer, batch):
            merge_batch(table, rows, detect(rows), now(batch), scope, writer, batch)

    return (
        packages.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
