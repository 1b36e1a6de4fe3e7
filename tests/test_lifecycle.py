import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from poolscope.operators import lifecycle as lc

T0, NOW = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)


def issue(package, errno=302, filename="f", level=0, detail="{}", **more):
    return {"package": package, "version": "1", "repo": "r", "errno": errno, "level": level, "filename": filename,
            "ctime": T0, "mtime": T0, "atime": T0, "detail": detail, **more}


def now():
    return F.lit(NOW)


def test_merge_actions_and_idempotence(make, spark):
    issues = make("issues", [
        issue("gone"), issue("kept-untouched"), issue("same"), issue("newdetail"), issue("late"),
        issue("always", 411), issue("nullfile", 411, None),
    ])
    found = make("issues", [
        issue("same"), issue("newdetail", detail='{"a":1}'), issue("late", level=1), issue("fresh"), issue("nullfile", 411, None),
    ]).select("package", "version", "repo", "errno", "level", "filename", "detail")
    changed = make("packages", [{"package": p, "version": "1", "repo": "r"} for p in ("gone", "same", "newdetail", "fresh")])
    acts = dict(rows(lc.merge_actions(issues, found, changed, now()), "package", "action"))
    assert acts == {"gone": "retire", "kept-untouched": "keep", "same": "refresh", "newdetail": "update", "late": "update",
                    "always": "retire", "nullfile": "refresh", "fresh": "insert"}
    once = lc.merge_issues(issues, found, changed, now())
    by = {r.package: r for r in once.collect()}
    assert by["late"].level == 1 and by["late"].mtime == NOW and by["late"].atime == T0
    assert by["same"].mtime == T0 and by["same"].atime == NOW and by["fresh"].ctime == NOW
    twice = lc.merge_issues(once, found, changed, now())
    assert rows(once) == rows(twice)
    steps = lc.touched(issues, changed)
    assert rows(lc.retire(steps, found), "package") == [("always",), ("gone",)]
    assert rows(lc.insert_new(issues, found, now()), "package") == [("fresh",)]
    assert rows(lc.update_changed(issues, found, now()), "package") == [("late",), ("newdetail",)]


def test_scope_and_repeated_keys(make, spark):
    issues = make("issues", [issue("a", n) for n in (101, 302, 411)] + [issue("b", 302), issue("c", 431)])
    changed = make("packages", [{"package": p, "version": "1", "repo": "r"} for p in ("a", "c")])
    none = make("issues", []).select("package", "version", "repo", "errno", "level", "filename", "detail")
    scope = lc.Scope(whole=frozenset({411}), changed=frozenset({302, 431}))
    assert rows(lc.merge_issues(issues, none, changed, now(), scope), "package", "errno") == [("a", 101), ("b", 302)]
    assert rows(lc.merge_issues(issues, none, changed, now(), lc.Scope()), "package", "errno") == rows(issues, "package", "errno")
    twice = make("issues", [issue("n", level=1, detail="z"), issue("n", level=1, detail="a"), issue("n", level=2)]).select(none.columns)
    for parts in (1, 3):
        got = lc.merge_issues(issues, twice.repartition(parts), changed, now(), scope).filter("package = 'n'")
        assert rows(got, "level", "detail") == [(1, "a")]
        assert rows(lc.insert_new(issues, twice.repartition(parts), now()), "level", "detail") == [(1, "a")]


def test_stream_merges_within_its_scope(make, spark, tmp_path):
    from poolscope.schemas import schema
    from poolscope.streaming.changes import issue_table, stream_snapshot_merge

    start = make("issues", [issue("p1"), issue("p1", 411), issue("p3"), issue("other", 431), issue("other")])
    source = tmp_path / "in"
    for n in range(5):
        make("packages", [{"package": f"p{n}", "version": "1", "repo": "r", "size": n}]).coalesce(1).write.mode("append").parquet(str(source))
    arrivals = spark.readStream.schema(schema("packages")).option("maxFilesPerTrigger", 1).parquet(str(source))

    def detect(rows_):
        return rows_.filter("size > 2").select("package", "version", "repo", F.lit(302).alias("errno"), F.lit(0).alias("level"),
                                               F.lit("f").alias("filename"), F.lit("{}").alias("detail"))

    table = issue_table(spark, str(tmp_path / "issues"), 4)
    table.append(start)
    scope = lc.Scope(changed=frozenset({302}))
    stream_snapshot_merge(arrivals, table, detect, lambda n: now(), str(tmp_path / "check"), scope).awaitTermination()
    assert rows(table.read(), "package", "errno") == [("other", 302), ("other", 431), ("p1", 411), ("p3", 302), ("p4", 302)]


def test_changed_since_and_purge(make):
    packages = make("packages", [{"package": p, "version": "1", "repo": "r", "mtime": m} for p, m in (("a", 0), ("b", 1577836800))])
    assert rows(lc.changed_since(packages, make("issues", [])), "package") == [("a",), ("b",)]
    assert rows(lc.changed_since(packages, make("issues", [issue("x")])), "package") == [("b",)]
    issues = make("issues", [issue("a"), issue("a", 412), issue("old"), issue("s", 103, repo="t/stable"), issue("s2", 103, repo="t/stable")])
    left = lc.purge_stale(
        issues, packages, make("tree_branches", [{"name": "t/stable", "tree": "t", "branch": "stable"}]),
        make("source_versions", [{"package": "s", "branch": "stable", "version": "1", "release": "0"}]),
    )
    assert rows(left, "package", "errno") == [("a", 302), ("s", 103)]


def test_stats(make):
    issues = make("issues", [issue("a"), issue("a", 303), issue("b"), issue("c", repo="t/stable")])
    latest = make("packages", [{"package": p, "repo": r} for p, r in (("a", "r"), ("b", "r"), ("c", "q"))])
    args = (latest, make("sources", [{"name": "c", "tree": "t"}]),
            make("source_versions", [{"package": "c", "branch": "stable"}]),
            make("tree_branches", [{"name": "t/stable", "tree": "t", "branch": "stable"}]))
    got = lc.issue_stats(issues, *args)
    assert rows(got) == rows(got.sparkSession.createDataFrame([
        ("", 0, 3, 1), ("", 302, 3, 1), ("", 303, 1, 1), ("r", 0, 2, 2), ("r", 302, 2, 2), ("r", 303, 1, 2),
        ("t/stable", 0, 1, 1), ("t/stable", 302, 1, 1)], got.schema))
    assert rows(lc.issue_stats(issues.limit(0), *args)) == [("", 0, 0, 1)]
    history = got.withColumn("updated", F.lit(T0))
    assert lc.append_if_changed(history, got).isEmpty()
    moved = history.unionByName(history.filter("errno = 303").withColumn("cnt", F.lit(9).cast("bigint")).withColumn("updated", F.lit(NOW)))
    assert rows(lc.append_if_changed(moved, got), "repo", "errno") == [("", 303), ("r", 303)]
