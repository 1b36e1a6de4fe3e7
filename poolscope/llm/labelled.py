"""A bounded sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.tables import held_out

FOLDS = 5
SAMPLE = 10_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, folds: int = FOLDS, seed: int = 3
) -> DataFrame:
    """(doc_id, text, y) of at most ``sample`` labelled rows outside the held-out fold.

    The rows of least hash are taken, so the choice depends on ids alone; a document
    labelled more than once has its greatest label. The sample's ids are few enough
    to be sent to the tasks that read the texts. Null ids, labels and texts are not
    learnt from.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id", folds, 0))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    )
    wanted = docs.sparkSession.createDataFrame(
        known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample).toArrow()
    )
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(wanted), "doc_id")
    return rows.select("doc_id", "text", "y")
