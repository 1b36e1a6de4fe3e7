from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.functions.text import json_object
from poolscope.functions.versions import full_version


def findings(
    df: DataFrame,
    errno: int,
    filename: Column,
    detail: Column | None = None,
    level: Column | int = 0,
    package: Column | str = "package",
    version: Column | str = "version",
    repo: Column | str = "repo",
) -> DataFrame:
    def col(c):
        return F.col(c) if isinstance(c, str) else c

    return df.select(
        col(package).alias("package"),
        col(version).alias("version"),
        col(repo).alias("repo"),
        F.lit(errno).alias("errno"),
        (F.lit(level) if isinstance(level, int) else level).cast("int").alias("level"),
        filename.alias("filename"),
        (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
    )


def fields(**named: Column | str) -> Column:
    """JSON detail with the given fields in order."""
    return json_object(
        *[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in named.items()]
    )


def source_full_version(alias: str = "") -> Column:
    return full_version(
        F.col(alias + "epoch"), F.col(alias + "version"), F.col(alias + "release")
    )
