"""Detectors on package files and their content: 301-303, 311, 321-324, 412.

``packages`` and ``latest`` are the changed rows only, unless every row is to be
examined (see ``poolscope.operators.lifecycle.changed_since``).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.functions.paths import expected_pool_filename, join_path, permission_bit
from poolscope.functions.scan import grouped_median
from poolscope.operators.detectors.common import fields, findings, source_full_version
from poolscope.schemas import PACKAGE_KEY

# Fixed values of the file rules.
SMALL_FILE_LIMIT = 10485760
MAINTAINER_PATTERN = "^.+ <.+@.+>$"
TOP_DIRECTORIES = ("bin", "boot", "etc", "lib", "opt", "run", "sbin", "srv", "usr", "var")
EMPTY_BY_CONVENTION = (
    "NEWS", "ChangeLog", "INSTALL", "TODO", "COPYING", "AUTHORS",
    "README", "README.md", "README.txt", "empty", "placeholder", "placeholder.txt",
)
PROGRAM_DIRECTORIES = ("bin", "sbin", "usr/bin")
LAST_SYSTEM_ID = 999


def detect_301(packages: DataFrame) -> DataFrame:
    """Unreadable archives."""
    bad = packages.filter(F.col("debtime").isNull())
    return findings(bad, 301, F.col("filename"), fields(size="size"))


def detect_302(packages: DataFrame, latest: DataFrame, median: DataFrame | None = None) -> DataFrame:
    """Files below a third of the package's median size.

    The median is that of ``packages``, or a given one (package, medsize), such as the
    stored counts of ``poolscope.plans.sizes`` give it over all rows.
    """
    if median is None:
        median = grouped_median(
            packages.filter(F.col("debtime").isNotNull()), "package", "size", "medsize"
        )
    small = (
        latest.filter(F.col("debtime").isNotNull() & (F.col("size") < SMALL_FILE_LIMIT))
        .join(median, "package")
        .filter(F.col("size") < F.col("medsize") / 3)
    )
    return findings(small, 302, F.col("filename"), fields(size="size", medsize="medsize"))


def detect_303(packages: DataFrame, repos: DataFrame) -> DataFrame:
    """Files that are not where their name and version put them."""
    place = repos.select(F.col("name").alias("repo"), F.col("path").alias("repo_path"))
    named = packages.join(place, "repo").withColumn(
        "suggestion",
        expected_pool_filename(
            F.col("package"), F.col("version"), F.col("architecture"), F.col("repo_path")
        ),
    )
    wrong = named.filter(F.col("filename") != F.col("suggestion"))
    return findings(wrong, 303, F.col("filename"), fields(suggestion="suggestion"))


def detect_311(
    latest: DataFrame, repos: DataFrame, sources: DataFrame, tree_branches: DataFrame,
    versions: DataFrame, placeholder: str | None = None,
) -> DataFrame:
    """Maintainers without a mail address, or the placeholder packager."""
    bad = ~F.col("maintainer").rlike(MAINTAINER_PATTERN)
    if placeholder is not None:
        bad = bad | (F.col("maintainer") == placeholder)
    commits = versions.select(
        F.col("package").alias("_p"), F.col("branch").alias("_b"),
        source_full_version().alias("_v"), "committer", "githash",
    )
    hits = (
        latest.filter(bad)
        .select(*PACKAGE_KEY, "filename", "maintainer")
        .join(repos.select(F.col("name").alias("repo"), F.col("testing").alias("priority")), "repo")
        .join(sources.select(F.col("name").alias("package"), "tree"), "package", "left")
        .join(tree_branches.select("tree", "priority", "branch"), ["tree", "priority"], "left")
        .join(
            commits,
            (F.col("package") == F.col("_p"))
            & (F.col("branch") == F.col("_b"))
            & (F.col("version") == F.col("_v")),
            "left",
        )
    )
    return findings(
        hits, 311, F.col("filename"),
        fields(maintainer="maintainer", committer="committer", tree="tree", githash="githash"),
    )


def _file_findings(
    files: DataFrame, latest: DataFrame, errno: int, rule: Column, level: Column | int = 0
) -> DataFrame:
    """Files of the given packages that break a rule; the rule runs before the join."""
    hits = files.filter(rule).join(latest.select(*PACKAGE_KEY), PACKAGE_KEY, "left_semi")
    return findings(
        hits, errno, join_path(F.col("path"), F.col("name")),
        fields(
            size="size", perm="perm", uid="uid", gid="gid", uname="uname", gname="gname",
            ftype="ftype",
        ),
        level=level,
    )


def detect_321(files: DataFrame, latest: DataFrame, exempt: tuple[str, ...] = ()) -> DataFrame:
    """Regular files outside the allowed top-level directories."""
    path = F.col("path")
    rule = (F.col("ftype") == "reg") & (
        (path == "usr/local") | ~reduce(or_, (path.startswith(d) for d in TOP_DIRECTORIES))
    )
    if exempt:
        rule = rule & ~F.col("package").isin(*exempt)
    return _file_findings(files, latest, 321, rule)


def detect_322(files: DataFrame, latest: DataFrame) -> DataFrame:
    """Empty executable files, except those that are empty by convention."""
    name = F.col("name")
    rule = (
        (F.col("size") == 0)
        & (F.col("ftype") == "reg")
        & (permission_bit(F.col("perm"), 1) == 1)
        & ~name.isin(*EMPTY_BY_CONVENTION)
        & ~name.like(".%")
        & ~name.like("__init__.p%")
    )
    return _file_findings(files, latest, 322, rule, 1 - permission_bit(F.col("perm"), 1))


def detect_323(files: DataFrame, latest: DataFrame) -> DataFrame:
    """Files owned by a non-system user or group."""
    rule = (F.col("uid") > LAST_SYSTEM_ID) | (F.col("gid") > LAST_SYSTEM_ID)
    level = -F.when(F.col("ftype") == "reg", permission_bit(F.col("perm"), 1)).otherwise(
        permission_bit(F.col("perm"), 2)
    )
    return _file_findings(files, latest, 323, rule, level)


def detect_324(files: DataFrame, latest: DataFrame) -> DataFrame:
    """Programs that cannot be run and directories that cannot be entered."""
    rule = (
        F.col("path").isin(*PROGRAM_DIRECTORIES)
        & (permission_bit(F.col("perm"), 1) == 0)
        & (F.col("ftype") == "reg")
    ) | ((F.col("ftype") == "dir") & (permission_bit(F.col("perm"), 64) == 0))
    return _file_findings(files, latest, 324, rule)


def detect_412(duplicates: DataFrame, packages: DataFrame) -> DataFrame:
    """Several files of one package, version and repository."""
    kept = packages.select(*PACKAGE_KEY, F.col("filename").alias("kept"))
    grouped = (
        duplicates.select(*PACKAGE_KEY, "filename")
        .join(kept, PACKAGE_KEY)
        .groupBy(*PACKAGE_KEY)
        .agg(
            F.min("kept").alias("kept"),
            F.array(F.sort_array(F.collect_list("filename"))).alias("filenames"),
        )
    )
    return findings(grouped, 412, F.col("kept"), fields(filenames="filenames"))
