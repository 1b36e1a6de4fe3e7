"""Python workers find this package where the driver has it."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark: SparkSession) -> SparkSession:
    """Put the folder of the package on the workers' module path, for functions run from now on.

    Clusters whose executors do not see that folder get the package with ``--py-files``.
    """
    settings = spark.sparkContext.environment
    paths = [p for p in settings.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        settings["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
