"""Life-cycle of issues and their statistics history."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope.functions.versions import full_version
from poolscope.schemas import ISSUE_KEY, PACKAGE_KEY

# Always re-examined, and always recomputed from scratch.
ALWAYS_TOUCHED = (401, 402, 411, 431)
ALWAYS_PURGED = (301, 402, 412)
OVER_ALL_ROWS = (101, 102, 103, *ALWAYS_TOUCHED)


@dataclass(frozen=True)
class Scope:
    """What a run examined: numbers over all rows, and numbers over changed packages only.

    Issues outside it are kept as they are, whatever the findings.
    """

    whole: frozenset[int] = frozenset()
    changed: frozenset[int] = frozenset()

    @staticmethod
    def of(numbers: Iterable[int]) -> Scope:
        """The scope of an analysis with these detectors."""
        whole = frozenset(numbers) & frozenset(OVER_ALL_ROWS)
        return Scope(whole, frozenset(numbers) - whole)


def purge_stale(
    issues: DataFrame, latest: DataFrame, tree_branches: DataFrame, versions: DataFrame
) -> DataFrame:
    """Issues that still refer to a latest package or to a source version."""
    branches = tree_branches.select(F.col("name").alias("repo"), F.col("branch").alias("_branch"))
    binary = (
        issues.join(branches, "repo", "left_anti")
        .filter(~F.col("errno").isin(*ALWAYS_PURGED))
        .join(latest.select(*PACKAGE_KEY), PACKAGE_KEY, "left_semi")
    )
    known = versions.select(
        "package",
        F.col("branch").alias("_branch"),
        full_version(F.col("epoch"), F.col("version"), F.col("release")).alias("version"),
    )
    source = (
        issues.join(branches, "repo")
        .join(known, ["package", "_branch", "version"], "left_semi")
        .drop("_branch")
    )
    return binary.unionByName(source)


def last_analysis(issues: DataFrame) -> DataFrame:
    """High-water mark: the newest access time of any issue (null when none)."""
    return issues.agg(F.max("atime").alias("mark"))


def changed_since(df: DataFrame, issues: DataFrame, time: str = "mtime") -> DataFrame:
    """Rows modified at or after the last analysis; all rows when there was none.

    ``time`` may name an arrival-time column instead of the file's own time.
    """
    kind = df.schema[time].dataType
    mark = last_analysis(issues)
    if kind.typeName() in ("long", "integer"):
        at = F.unix_seconds(F.col("mark").cast("timestamp"))
        zero = F.lit(0)
    else:
        at, zero = F.col("mark").cast(kind), F.lit("1970-01-01").cast(kind)
    return df.filter(F.col(time) >= F.coalesce(mark.select(at).scalar(), zero))


def _always_touched() -> Column:
    return (F.col("errno") < 200) | F.col("errno").isin(*ALWAYS_TOUCHED)


def with_touched(issues: DataFrame, changed: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Add ``touched``: the issue is subject to this run (all detectors without ``scope``)."""
    keys = changed.select(*PACKAGE_KEY).distinct().withColumn("_changed", F.lit(True))
    hit = F.coalesce("_changed", F.lit(False))
    if scope is None:
        touched = hit | _always_touched()
    else:
        touched = F.col("errno").isin(*scope.whole) | (hit & F.col("errno").isin(*scope.changed))
    return issues.join(keys, PACKAGE_KEY, "left").withColumn("touched", touched).drop("_changed")


def touched(issues: DataFrame, changed: DataFrame, scope: Scope | None = None) -> DataFrame:
    return with_touched(issues, changed, scope).filter("touched").drop("touched")


def one_per_key(found: DataFrame) -> DataFrame:
    """Findings with equal keys as one: the least level, then the least detail."""
    least = F.min(F.struct("level", "detail")).alias("_least")
    one = found.groupBy(*ISSUE_KEY).agg(least)
    return one.select(*ISSUE_KEY, "_least.level", "_least.detail").select(*found.columns)


def _same_key(left: str, right: str) -> Column:
    same = F.lit(True)
    for c in ISSUE_KEY:
        same = same & F.col(left + c).eqNullSafe(F.col(right + c))
    return same


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def retire(touched_issues: DataFrame, found: DataFrame) -> DataFrame:
    """Touched issues that were not found again (they are to be deleted)."""
    keys = _prefixed(found.select(*ISSUE_KEY), "f_")
    return touched_issues.join(keys, _same_key("", "f_"), "left_anti")


def refresh(touched_issues: DataFrame, now: Column) -> DataFrame:
    return touched_issues.withColumn("atime", now)


def merge_actions(
    issues: DataFrame, found: DataFrame, changed: DataFrame, now: Column, scope: Scope | None = None
) -> DataFrame:
    """Every issue after the run with what happened to it.

    ``action`` is insert, update, refresh, keep or retire; retired rows are still
    present. One full outer join on the natural key, which is unique per side.
    """
    left = _prefixed(with_touched(issues, changed, scope), "i_").withColumn("_old", F.lit(True))
    right = _prefixed(one_per_key(found), "f_").withColumn("_new", F.lit(True))
    both = left.join(right, _same_key("i_", "f_"), "full_outer")
    old, new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    same = F.col("i_level").eqNullSafe(F.col("f_level")) & F.col("i_detail").eqNullSafe(
        F.col("f_detail")
    )
    action = (
        F.when(~old, "insert")
        .when(new & ~same, "update")
        .when(F.col("i_touched") & ~new, "retire")
        .when(F.col("i_touched"), "refresh")
        .otherwise("keep")
    )
    def pick(c: str) -> Column:
        return F.when(old, F.col("i_" + c)).otherwise(F.col("f_" + c)).alias(c)

    def value(c: str) -> Column:
        return F.when(new, F.col("f_" + c)).otherwise(F.col("i_" + c)).alias(c)

    kind = issues.schema["atime"].dataType
    now = now.cast(kind)
    return both.withColumn("action", action).select(
        *[pick(c) for c in ("package", "version", "repo", "errno")],
        value("level"),
        pick("filename"),
        F.when(old, F.col("i_ctime")).otherwise(now).alias("ctime"),
        F.when(F.col("action").isin("insert", "update"), now)
        .otherwise(F.col("i_mtime")).alias("mtime"),
        F.when(~old | F.col("i_touched"), now).otherwise(F.col("i_atime")).alias("atime"),
        value("detail"),
        "action",
    )


def merge_issues(
    issues: DataFrame, found: DataFrame, changed: DataFrame, now: Column, scope: Scope | None = None
) -> DataFrame:
    """The issue table after the run."""
    return merge_actions(issues, found, changed, now, scope).filter("action <> 'retire'").drop("action")


def update_changed(issues: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Issues whose level or detail changed, with the new values."""
    new = _prefixed(one_per_key(found), "f_")
    same = F.col("level").eqNullSafe(F.col("f_level")) & F.col("detail").eqNullSafe(F.col("f_detail"))
    return (
        issues.join(new, _same_key("", "f_"))
        .filter(~same)
        .withColumn("level", F.col("f_level"))
        .withColumn("detail", F.col("f_detail"))
        .withColumn("mtime", now.cast(issues.schema["mtime"].dataType))
        .select(*issues.columns)
    )


def insert_new(issues: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Findings that are not yet an issue, as issue rows."""
    known = _prefixed(issues.select(*ISSUE_KEY), "i_")
    now = now.cast(issues.schema["atime"].dataType)
    fresh = one_per_key(found).join(known, _same_key("", "i_"), "left_anti")
    for c in ("ctime", "mtime", "atime"):
        fresh = fresh.withColumn(c, now)
    return fresh.select(*issues.columns)


def issue_stats(
    issues: DataFrame, latest: DataFrame, sources: DataFrame, versions: DataFrame,
    tree_branches: DataFrame,
) -> DataFrame:
    """Packages with issues per (repo, errno), repo, errno and overall, with totals.

    Empty repo and errno 0 stand for "all". The distinct packages are found once;
    grouping sets then work on the reduced rows.
    """
    seen = issues.select("repo", "errno", "package").distinct()
    count = F.count_distinct("package").alias("cnt")
    repo, errno = F.col("repo"), F.col("errno")
    counted = (
        seen.groupingSets([[repo, errno], [repo], [errno]], repo, errno)
        .agg(count)
        .unionByName(seen.agg(count), allowMissingColumns=True)
    )

    def totals(df: DataFrame, aggregate: Column) -> DataFrame:
        return (
            df.groupBy("_repo").agg(aggregate)
            .unionByName(df.agg(aggregate), allowMissingColumns=True)
        )

    binary = totals(latest.select(F.col("repo").alias("_repo"), "package"),
                    F.count("package").alias("_packages"))
    on_branch = (
        versions.select(F.col("package").alias("name"), "branch")
        .join(sources.select("name", "tree"), "name")
        .join(
            tree_branches.select(F.col("name").alias("_repo"), "tree", "branch"),
            ["tree", "branch"],
        )
    )
    source = totals(on_branch, F.count_distinct("name").alias("_sources")).withColumnRenamed(
        "_repo", "_branch"
    )
    return (
        counted.join(binary, F.col("_repo").eqNullSafe(F.col("repo")), "left")
        .join(source, F.col("_branch").eqNullSafe(F.col("repo")), "left")
        .select(
            F.coalesce("repo", F.lit("")).alias("repo"),
            F.coalesce("errno", F.lit(0)).alias("errno"),
            "cnt",
            F.coalesce("_sources", "_packages").alias("total"),
        )
    )


def append_if_changed(history: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics rows that differ from the newest recorded row."""
    newest = Window.partitionBy("repo", "errno").orderBy(F.col("updated").desc_nulls_last())
    current = (
        history.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1")
        .select(*[F.col(c).alias("_" + c) for c in ("repo", "errno", "cnt", "total")])
    )
    same = F.lit(True)
    for c in ("repo", "errno", "cnt", "total"):
        same = same & F.col(c).eqNullSafe(F.col("_" + c))
    return stats.select("repo", "errno", "cnt", "total").join(current, same, "left_anti")
