"""One analysis run: purge, detect, merge, count."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.operators import catalogue, lifecycle
from poolscope.operators.detectors import (
    archives, collisions, dependencies, libraries, sources,
)
from poolscope.plans.commits import Committed
from poolscope.plans.pathindex import PathIndex
from poolscope.plans.sizes import SizeCounts
from poolscope.plans.storage import stored
from poolscope.schemas import PACKAGE_KEY


#: Detectors worked out and written together, as they read the same tables. A plan of all of them at once, with the tables it
#: sends to every task, takes more of the driver's memory than any group.
GROUPS = (
    (101, 102, 103, 401, 402), (301, 302, 303, 311, 412), (321, 322, 323, 324), (411,), (421,), (431,), (432,),
)


@dataclass
class Tables:
    """The catalogue. ``issues`` are those of the previous run."""

    repos: DataFrame
    packages: DataFrame
    duplicates: DataFrame
    dependencies: DataFrame
    sodep: DataFrame
    files: DataFrame
    issues: DataFrame
    trees: DataFrame
    tree_branches: DataFrame
    sources: DataFrame
    source_dups: DataFrame
    source_versions: DataFrame
    source_deps: DataFrame
    marks: DataFrame
    package_rel: DataFrame
    basherr: DataFrame


@dataclass
class Views:
    """Derived views of one run, written once because many detectors read them."""

    latest: DataFrame
    atoms: DataFrame
    breaks: DataFrame
    issues: DataFrame
    changed_packages: DataFrame
    changed_latest: DataFrame
    full: bool


def derive(t: Tables, full: bool = False) -> Views:
    """Latest packages, dependency atoms, soname breaks, live issues, what changed.

    The last analysis is dated by the issues left after the stale ones are gone.
    The breaks read the previous issues, so detector 432 sees the 431 findings of
    the run before. With ``full`` every row counts as changed.
    """
    latest = stored(catalogue.latest_packages(t.packages), "latest")
    atoms = stored(catalogue.dependency_atoms(t.dependencies, latest), "atoms")
    breaks = stored(
        catalogue.soname_breaks(t.sodep, latest, t.repos, t.issues), "breaks"
    )
    issues = stored(
        lifecycle.purge_stale(t.issues, latest, t.tree_branches, t.source_versions), "kept-issues"
    )
    if full:
        return Views(latest, atoms, breaks, issues, t.packages, latest, True)
    return Views(
        latest, atoms, breaks, issues,
        lifecycle.changed_since(t.packages, issues),
        lifecycle.changed_since(latest, issues),
        False,
    )


def detect_all(
    t: Tables, v: Views, core_tree: str, placeholder: str | None = None,
    exempt: tuple[str, ...] = (), strict_compat: bool = False, or_groups: bool = False,
    which: set[int] | None = None, sizes: SizeCounts | None = None, paths: PathIndex | None = None,
    arrived: DataFrame | None = None,
) -> DataFrame:
    """Findings of all detectors, or of those in ``which``, written group by group.

    With ``sizes`` the median of 302 covers all rows in every run, without it those
    examined. With ``paths``, an index that holds what ``files`` does, an incremental 421 takes the
    other owners of changed paths from its buckets; ``arrived`` has the files of the changed latest
    packages where the caller has them at hand, otherwise they are picked from ``files``.
    """
    new, changed = v.latest, v.changed_latest
    scripts = (t.basherr, t.package_rel, t.marks, t.trees, t.source_versions, t.sources)

    def closure() -> DataFrame:
        current = catalogue.source_packages(t.sources, t.trees, t.source_versions)
        edges = libraries.satisfied_edges(t.source_deps, current)
        # 432 reads the closure of changed users outside the core tree only.
        outside = t.sources.filter(F.col("tree") != core_tree).select(F.col("name").alias("package"))
        users = changed.select("package").join(outside, "package", "left_semi")
        return libraries.dependency_closure(edges, v.breaks, users=users)

    def owners() -> DataFrame:
        mine = t.files if arrived is None else arrived
        return paths.touched_owners(mine.join(changed.select(*PACKAGE_KEY), PACKAGE_KEY, "left_semi"))

    detectors = {
        101: lambda: sources.detect_101(*scripts),
        102: lambda: sources.detect_102(*scripts),
        103: lambda: sources.detect_103(t.sources, t.source_versions, t.tree_branches),
        301: lambda: archives.detect_301(v.changed_packages),
        302: lambda: archives.detect_302(
            v.changed_packages, changed, None if sizes is None else sizes.medians(changed)
        ),
        303: lambda: archives.detect_303(v.changed_packages, t.repos),
        311: lambda: archives.detect_311(
            changed, t.repos, t.sources, t.tree_branches, t.source_versions, placeholder
        ),
        321: lambda: archives.detect_321(t.files, changed, exempt),
        322: lambda: archives.detect_322(t.files, changed),
        323: lambda: archives.detect_323(t.files, changed),
        324: lambda: archives.detect_324(t.files, changed),
        401: lambda: sources.detect_401(
            t.sources, t.source_versions, t.tree_branches, t.source_deps, strict_compat
        ),
        402: lambda: sources.detect_402(t.sources, t.source_dups, t.trees, t.source_versions),
        411: lambda: dependencies.detect_411(v.atoms, new, t.repos, strict_compat, or_groups),
        412: lambda: archives.detect_412(t.duplicates, v.changed_packages),
        421: lambda: collisions.detect_421(
            t.files if v.full or paths is None else owners(),
            new, t.repos, v.atoms, None if v.full else changed,
        ),
        431: lambda: libraries.detect_431(t.sodep, new, t.repos, t.source_deps, strict_compat),
        432: lambda: libraries.detect_432(
            v.breaks, closure(), new, changed, t.repos, t.sources, t.sodep, t.source_deps,
            core_tree,
        ),
    }
    chosen = [[detectors[n] for n in group if which is None or n in which] for group in GROUPS]
    return reduce(DataFrame.unionByName, [
        stored(reduce(DataFrame.unionByName, [make() for make in group]), "findings") for group in chosen if group
    ])


def analyze(
    t: Tables, now: Column, core_tree: str, full: bool = False, **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(issues, statistics, findings) of one run.

    Findings are written once, by ``detect_all``; the merge and the statistics read them back. With
    ``which`` only issues of those detectors can be retired.
    """
    views = derive(t, full)
    which = options.get("which")
    scope = None if which is None else lifecycle.Scope.of(which)
    found = detect_all(t, views, core_tree, **options)
    issues = stored(
        lifecycle.merge_issues(views.issues, found, views.changed_packages, now, scope), "issues"
    )
    stats = lifecycle.issue_stats(
        issues, views.latest, t.sources, t.source_versions, t.tree_branches
    )
    return issues, stats, found


def record(
    issues: DataFrame, stats: DataFrame, issue_table: Committed, history: Committed, now: Column, run: int,
    writer: str = "analyze",
) -> None:
    """Commit a run's issues and its changed statistics; a run that is recorded again changes nothing.

    Readers of an earlier commit keep what they see. The issues go first: a run that
    fails between the two commits is completed when it is recorded again.
    """
    issue_table.replace(issues, writer=writer, batch=run)
    if not history.done(writer, run):
        changed = lifecycle.append_if_changed(history.read(), stats)
        kind = history.columns["updated"].dataType
        history.append(changed.withColumn("updated", now.cast(kind)), writer, run)
