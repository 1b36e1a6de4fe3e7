"""One inventory scan: which files changed, and the catalogue after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.functions.paths import repo_name, repo_realname
from poolscope.operators import changes
from poolscope.plans.storage import stored
from poolscope.schemas import DDL, PACKAGE_KEY

OWNED = ("dependencies", "sodep", "files")


def place_packages(packages: DataFrame, branches: DataFrame) -> DataFrame:
    """Add repository, real name, path and testing level.

    ``packages`` has branch and component (see ``pool_coordinates``); ``branches``
    has branch and testing.
    """
    arch, component = F.col("architecture"), F.col("component")
    return packages.join(branches.select("branch", "testing"), "branch").withColumns(
        {
            "repo": repo_name(arch, component, F.col("branch")),
            "realname": repo_realname(arch, component),
            "path": F.concat_ws("/", "branch", "component"),
        }
    )


def scan(
    tables: dict[str, DataFrame], listing: DataFrame, read: DataFrame, owned: dict[str, DataFrame],
    now: Column, digests: DataFrame | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, change events) after one scan.

    ``tables`` holds repos, packages, duplicates, dependencies, sodep and files as
    known; ``listing`` the files found; ``read`` the placed package rows of added
    and replaced files (unreadable ones without debtime); ``owned`` the
    dependency, soname and file rows of the readable ones.

    Files that vanished or were replaced leave packages and duplicates together
    with all rows of their package. A version found twice keeps its newest file,
    the others become duplicates. ``promoted`` of the result names duplicates that
    became packages: their content is that of the file before until they are read.
    """
    columns = [f.split()[0] for f in DDL["packages"].split(", ")]
    known = tables["packages"].select(*columns).unionByName(tables["duplicates"].select(*columns))
    status = stored(changes.diff_inventory(known, listing, digests), "inventory-status")
    left = status.filter("status IN ('deleted', 'replaced')").select("filename", "status")

    gone = known.join(left, "filename")
    dropped_packages = tables["packages"].join(left.select("filename"), "filename", "left_semi")
    kept_files = known.join(left.select("filename"), "filename", "left_anti")

    replaced = left.filter("status = 'replaced'").select("filename", F.lit(True).alias("replaced"))
    arrived = read.join(replaced, "filename", "left").withColumn(
        "replaced", F.coalesce("replaced", F.lit(False))
    )
    classified = changes.classify_changes(arrived, kept_files, order="filename")
    deleted = gone.filter("status = 'deleted'").join(
        tables["repos"].select(F.col("name").alias("repo"), "branch", "component"), "repo"
    )
    events = changes.published_changes(classified).unionByName(changes.deletion_events(deleted))

    packages, duplicates = changes.resolve_duplicates(
        stored(kept_files.unionByName(read.select(*columns)), "scanned-files")
    )
    # A duplicate takes the place of the dropped file of its version; the version's rows
    # stay until the promoted file is read.
    promoted = packages.join(tables["duplicates"].select("filename"), "filename", "left_semi").join(
        read.select("filename"), "filename", "left_anti"
    )
    lost = dropped_packages.select(*PACKAGE_KEY).join(promoted.select(*PACKAGE_KEY), PACKAGE_KEY, "left_anti")
    kept = {name: tables[name].join(lost, PACKAGE_KEY, "left_anti") for name in OWNED}
    # The content of a version belongs to the file that stays.
    fresh = packages.join(read.select("filename"), "filename", "left_semi").select(*PACKAGE_KEY)
    content = {
        name: kept[name].join(fresh, PACKAGE_KEY, "left_anti").unionByName(
            owned[name].join(fresh, PACKAGE_KEY, "left_semi")
        )
        for name in OWNED
    }
    seen = read.select(
        F.col("repo").alias("name"), "realname", "path", "testing", "branch", "component",
        "architecture", now.cast("timestamp").alias("mtime"),
    )
    repos = changes.register_repos(tables["repos"], seen)
    moved = gone.select("repo").union(read.select("repo"))
    return (
        {
            "repos": changes.touch_repos(repos, moved, now),
            "packages": packages,
            "duplicates": duplicates,
            **content,
            "promoted": promoted.select("filename"),
        },
        events,
    )
