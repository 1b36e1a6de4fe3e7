import datetime as dt
import hashlib

from pyspark.sql import functions as F

from conftest import rows
from poolscope.operators.changes import with_version_key
from poolscope.plans import analyze as an
from poolscope.plans.release import release
from poolscope.plans.scan import place_packages, scan
from poolscope.schemas import DDL


def now():
    return F.lit("2021-01-01 00:00:00").cast("timestamp")


def file(package, version, filename, size=10, mtime=1, **more):
    return {"package": package, "version": version, "repo": "amd64/stable", "architecture": "amd64", "filename": filename,
            "size": size, "mtime": mtime, "debtime": 1, "installed_size": 1, "maintainer": "A <a@b>", "description": "d",
            "sha256": "h", **more}


def empty(make):
    return {n: make(n, []) for n in ("repos", "packages", "duplicates", "dependencies", "sodep", "files")}


def arrive(spark, make, tables, items, listing):
    branches = spark.createDataFrame([("stable", 0)], "branch string, testing int")
    read = with_version_key(make("packages", items)).withColumns({"branch": F.lit("stable"), "component": F.lit("main")})
    placed = place_packages(read.drop("repo"), branches)
    owned = {n: make(n, []) for n in ("dependencies", "sodep", "files")}
    owned["files"] = make("files", [dict(package=i["package"], version=i["version"], repo=i["repo"], path="usr", name=i["filename"], ftype="reg")
                                    for i in items])
    found = spark.createDataFrame(listing, "filename string, size bigint, mtime bigint")
    return scan(tables, found, placed, owned, now())


def test_scan_twice_then_release(spark, make, tmp_path):
    a1, a2, copy = file("a", "1", "a1"), file("a", "2", "a2"), file("a", "1", "a1copy", mtime=5)
    tables, events = arrive(spark, make, empty(make), [a1, a2], [("a1", 10, 1), ("a2", 10, 1)])
    assert rows(events, "comp", "pkg", "method", "from_ver", "to_ver") == [
        ("stable-main", "a", "new", "", "1"), ("stable-main", "a", "upgrade", "1", "2")]
    assert rows(tables["repos"], "name", "path") == [("amd64/stable", "stable/main")]
    tables, events = arrive(spark, make, tables, [copy, file("b", "1", "b1")], [("a1", 10, 1), ("a1copy", 10, 5), ("b1", 10, 1)])
    assert rows(events, "pkg", "method", "from_ver", "to_ver") == [("a", "delete", "2", ""), ("b", "new", "", "1")]
    assert rows(tables["packages"], "filename") == [("a1copy",), ("b1",)]
    assert rows(tables["duplicates"], "filename") == [("a1",)]
    assert rows(tables["files"], "name") == [("a1copy",), ("b1",)]
    # The kept file of version 1 goes: its duplicate takes over with the rows known so far.
    tables, events = arrive(spark, make, tables, [file("b", "2", "b2")], [("a1", 10, 1), ("b1", 10, 1), ("b2", 10, 1)])
    assert rows(tables["packages"], "filename") == [("a1",), ("b1",), ("b2",)]
    assert rows(tables["promoted"], "filename") == [("a1",)]
    assert rows(tables["files"], "name") == [("a1copy",), ("b1",), ("b2",)]
    conf = spark.createDataFrame([("stable", "o", "l", "c", "d", 2, 1)],
                                 "branch string, origin string, label string, codename string, desc string, ttl int, renew_in int")
    published = spark.createDataFrame([], "branch string, released bigint, valid_until bigint")
    text = release(spark, tables, conf, published, now(), str(tmp_path / "dists")).first().manifest
    assert "Architectures: amd64\nComponents: main\nSHA256:\n " in text
    listed = [line.split() for line in text.split("SHA256:\n")[1].splitlines()]
    assert [n for _, _, n in listed] == [
        "main/Contents-amd64-00000", "main/Contents-amd64-00000.gz", "main/binary-all/Packages",
        "main/binary-amd64/Packages-00000", "main/binary-amd64/Packages-00000.gz"]
    for folder, name in (("packages", listed[3]), ("contents", listed[0])):
        (part,) = (tmp_path / "dists" / folder / "plain").rglob("part-*.txt")
        assert name[0] == hashlib.sha256(part.read_bytes()).hexdigest() and int(name[1]) == part.stat().st_size
    assert spark.read.text(str(tmp_path / "dists/contents/plain")).count() == 3


def test_release_keeps_fresh_branches(spark, make, tmp_path):
    def tables(items, times):
        repos = [{"name": f"amd64/{b}", "realname": "amd64", "architecture": "amd64", "component": "main", "testing": 0, "path": f"{b}/main",
                  "branch": b, "mtime": t} for b, t in times]
        return {"repos": make("repos", repos), "packages": with_version_key(make("packages", items)), "dependencies": make("dependencies", []),
                "files": make("files", [])}

    def published(folder, branch):
        return sorted((str(p.relative_to(folder)), p.read_bytes()) for p in folder.rglob("part-*") if f"branch={branch}" in str(p))

    conf = spark.createDataFrame([(b, "o", "l", "c", "d", 2, 1) for b in ("stable", "testing")],
                                 "branch string, origin string, label string, codename string, desc string, ttl int, renew_in int")
    early, late = dt.datetime(2020, 12, 1), dt.datetime(2020, 12, 30)
    none = spark.createDataFrame([], "branch string, released bigint, valid_until bigint")
    items = [{**file("a", "1", f"a-{b}"), "repo": f"amd64/{b}"} for b in ("stable", "testing")]
    target = tmp_path / "dists"
    first = release(spark, tables(items, [("stable", early), ("testing", early)]), conf, none, now(), str(target))
    assert rows(first, "branch") == [("stable",), ("testing",)]
    before = published(target, "stable")
    # A second run in which only testing is stale, and has lost its package.
    done = spark.createDataFrame([("stable", 1608000000, 1700000000), ("testing", 1608000000, 1700000000)], none.schema)
    second = release(spark, tables(items[:1], [("stable", early), ("testing", late)]), conf, done, now(), str(target))
    assert rows(second, "branch") == [("testing",)] and published(target, "stable") == before and before
    assert published(target, "testing") == []
    again = release(spark, tables(items[:1], [("stable", early), ("testing", late)]), conf, done, now(), str(target), force=True)
    assert rows(again, "branch") == [("stable",), ("testing",)]


def catalogue(make, packages, issues):
    tables = {n: make(n, []) for n in DDL}
    return an.Tables(
        repos=make("repos", [{"name": "amd64/stable", "architecture": "amd64", "component": "main", "testing": 0, "path": "stable/main", "branch": "stable"}]),
        packages=with_version_key(make("packages", packages)), issues=issues,
        **{n: tables[n] for n in ("duplicates", "dependencies", "sodep", "files", "trees", "tree_branches", "sources", "source_dups",
                                  "source_versions", "source_deps", "marks", "package_rel", "basherr")},
    )


def test_incremental_run_equals_full_run(make):
    old = [file("a", "1", "wrong"), file("b", "1", "x", debtime=None)]
    later = [file("c", "1", "also-wrong", mtime=2000000000)]
    which = {301, 302, 303, 311, 412}
    first, _, _ = an.analyze(catalogue(make, old, make("issues", [])), now(), "core", which=which)
    step, stats, _ = an.analyze(catalogue(make, old + later, first), now(), "core", which=which)
    full, _, _ = an.analyze(catalogue(make, old + later, make("issues", [])), now(), "core", full=True, which=which)
    key = ("package", "errno", "filename", "level", "detail")
    # Issues of an unreadable file go at the next run and return when it changes.
    assert rows(step.filter("package <> 'b'"), *key) == rows(full.filter("package <> 'b'"), *key)
    assert rows(full, "package", "errno") == [("a", 303), ("b", 301), ("b", 303), ("c", 303)]
    assert not stats.isEmpty()


def test_partial_run_keeps_foreign_issues(make):
    others = make("issues", [dict(package="b", version="1", repo="amd64/stable", errno=n, level=0, filename="x", ctime=dt.datetime(2030, 1, 1),
                                  mtime=dt.datetime(2030, 1, 1), atime=dt.datetime(2030, 1, 1), detail=None) for n in (411, 431, 303)])
    left, _, _ = an.analyze(catalogue(make, [file("b", "1", "x")], others), now(), "core", which={302})
    assert rows(left, "errno") == [(303,), (411,), (431,)]
    all_, _, _ = an.analyze(catalogue(make, [file("b", "1", "x")], others), now(), "core")
    assert rows(all_, "errno") == [(303,)]


def test_recorded_run_counts_once(spark, make, tmp_path):
    from poolscope.plans.commits import Committed
    from poolscope.schemas import schema
    from poolscope.streaming.changes import issue_table

    table = issue_table(spark, str(tmp_path / "issues"), 4)
    history = Committed(spark, str(tmp_path / "stats"), schema("issue_stats"))
    which = {303}
    for run, items in enumerate(([file("a", "1", "wrong")], [file("a", "1", "wrong"), file("b", "1", "wrong", mtime=2000000000)])):
        issues, stats, _ = an.analyze(catalogue(make, items, table.read()), now(), "core", which=which)
        for _ in range(2):
            an.record(issues, stats, table, history, now(), run)
    assert rows(table.read(0), "package") == [("a",)] and rows(table.read(), "package") == [("a",), ("b",)]
    assert rows(history.read().filter("repo = '' and errno = 303"), "cnt") == [(1,), (2,)]


def test_views_stay_where_nothing_was_modified(spark, make):
    from poolscope.plans import views

    repos = make("repos", [{"name": "amd64/stable", "architecture": "amd64", "component": "main", "testing": 0, "path": "stable/main", "branch": "stable"}])
    def source(*items):
        return views.Sources(with_version_key(make("packages", list(items))), make("dependencies", [
            {"package": "a", "version": v, "repo": "amd64/stable", "relationship": "Depends", "value": f"x{v}"} for v in "12"]), make("sodep", []), repos)

    before, after = source(file("a", "1", "a1"), file("b", "1", "b1")), source(file("a", "1", "a1"), file("a", "2", "a2"))
    first = views.build(before)
    at = [spark.createDataFrame([(n,)], "modified long") for n in (5, 6)]
    changed = make("packages", [file("a", "2", "a2"), file("b", "1", "b1")])
    assert views.refresh(first, before, after, changed, at[0], at[0]) is first
    later, whole = views.refresh(first, before, after, changed, *at), views.build(after)
    assert rows(later.latest, "filename") == rows(whole.latest, "filename") == [("a2",)]
    assert rows(later.atoms, "package", "deppkg") == rows(whole.atoms, "package", "deppkg") == [("a", "x2")]


def test_findings_are_written_group_by_group(make):
    given = empty(make) | {n: make(n, []) for n in ("issues", "trees", "tree_branches", "sources", "source_dups", "source_versions",
                                                     "source_deps", "marks", "package_rel", "basherr")}
    item = file("a", "1", "a1", debtime=None)
    t = an.Tables(**(given | {"packages": with_version_key(make("packages", [item]))}))
    found = an.detect_all(t, an.derive(t, full=True), "core")
    # One plan of all detectors would keep all their tables in the driver; what is handed over only reads what was written.
    assert sorted(n for group in an.GROUPS for n in group) == [101, 102, 103, 301, 302, 303, 311, 321, 322, 323, 324, 401, 402, 411, 412, 421, 431, 432]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == len(an.GROUPS) and "Join" not in plan
    assert rows(found, "package", "errno") == [("a", 301)]


def test_latest_packages_of_the_detectors_are_written_narrow(spark, make, monkeypatch):
    from poolscope.checks import queries
    from poolscope.checks.fixtures import Fixtures

    every = with_version_key(make("packages", [file("a", "1", "a1"), file("a", "2", "a2"), file("b", "1", "b1", debtime=None)]))
    monkeypatch.setattr(queries, "kept_packages", lambda fx: every)
    latest = queries.detected_latest(Fixtures(spark, "no folder"))
    assert rows(latest, "package", "version", "filename", "size") == [("a", "2", "a2", 10)]
    assert not {"description", "maintainer"} & set(latest.columns)
