import random

from pyspark.sql import functions as F

from conftest import rows
from poolscope.operators import changes as ch
from poolscope.operators.lifecycle import Scope
from poolscope.sinks import index
from poolscope.streaming.changes import issue_table, merge_batch, stream_changes, stream_snapshot_merge
from test_versions import compare

ARRIVAL = "package string, repo string, seq int, version string, branch string, component string, architecture string, debtime int"


def arrivals(spark, n=120, seed=2):
    rnd = random.Random(seed)
    data = [("hot" if i % 3 else f"p{i % 5}", f"r{i % 2}", i, f"{rnd.randrange(4)}.{rnd.randrange(12)}", "b", "c", "a",
             None if i % 17 == 0 else 1) for i in range(n)]
    return data, spark.createDataFrame(data, ARRIVAL)


def replay(data, known=()):
    seen, top, out = set(known), {}, {}
    for p, r, v in known:
        if (p, r) not in top or compare(top[p, r], v) < 0:
            top[p, r] = v
    for p, r, seq, v, *_ in data:
        old = top.get((p, r))
        if old is None:
            out[seq] = ("new", "", v)
        elif (p, r, v) in seen:
            out[seq] = ("duplicate", v, v)
        elif compare(old, v) < 0:
            out[seq] = ("upgrade", old, v)
        else:
            out[seq] = ("old", old, v)
        seen.add((p, r, v))
        if old is None or compare(old, v) < 0:
            top[p, r] = v
    return out


def test_classify_matches_replay(spark):
    data, df = arrivals(spark)
    got = {r.seq: (r.method, r.from_ver, r.to_ver) for r in ch.classify_changes(df, order="seq", block=F.floor(F.col("seq") / 7)).collect()}
    assert got == replay(data)
    known = [("hot", "r0", "2.3"), ("hot", "r0", "1.1"), ("p1", "r1", "0.1")]
    kdf = spark.createDataFrame(known, "package string, repo string, version string")
    got = {r.seq: (r.method, r.from_ver, r.to_ver) for r in ch.classify_changes(df, kdf, order="seq").collect()}
    assert got == replay(data, known)


def test_stream_equals_batch(spark, tmp_path):
    """Files arrive in order, several a batch; the stream is stopped and started between them."""
    data, df = arrivals(spark)
    df = df.withColumn("debtime", F.when(F.col("seq") % 7 > 0, 1)).withColumn("replaced", F.when(F.col("seq") % 9 == 0, True))
    source = str(tmp_path / "in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in range(4):
        df.filter(f"seq >= {part * 30} AND seq < {part * 30 + 30}").repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        stream_changes(stream, str(tmp_path / "out"), order="seq").awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out/events")), "pkg", "method", "from_ver", "to_ver")
    want = rows(ch.published_changes(ch.classify_changes(df, order="seq")), "pkg", "method", "from_ver", "to_ver")
    assert got == want and {r[1] for r in want} == {"new", "upgrade", "overwrite"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def unreadable(df):
    return df.filter("debtime IS NULL").select(
        "package", "version", "repo", F.lit(301).alias("errno"), F.lit(0).alias("level"), "filename", F.lit("{}").alias("detail"))


def test_stream_snapshot_merge(spark, make, tmp_path):
    packages = make("packages", [{"package": "a", "version": "1", "repo": "r", "filename": "a.deb"}])
    source, table = str(tmp_path / "in"), issue_table(spark, str(tmp_path / "issues"), 4)
    packages.write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(packages.schema).parquet(source)
        stream_snapshot_merge(stream, table, unreadable, lambda b: F.lit(f"2020-01-0{b + 1}").cast("timestamp"),
                              str(tmp_path / "check"), Scope(changed=frozenset({301}))).awaitTermination()
        packages.withColumn("debtime", F.lit(1).cast("bigint")).write.mode("append").parquet(source)
    assert rows(table.read(0), "package", "errno") == [("a", 301)] and table.read(1).isEmpty()


def test_merge_of_findings_on_other_packages(spark, make, tmp_path):
    """A finding on a package that did not arrive keeps the times of its issue; replays change nothing."""
    table = issue_table(spark, str(tmp_path / "issues"), 8)
    scope = Scope(changed=frozenset({421}))

    def found(*names):
        return make("issues", [{"package": n, "version": "1", "repo": "r", "errno": 421, "level": 0, "filename": "f"} for n in names]).select(
            "package", "version", "repo", "errno", "level", "filename", "detail")

    def arrived(*names):
        return make("packages", [{"package": n, "version": "1", "repo": "r"} for n in names])

    def day(n):
        return F.lit(f"2020-01-0{n}").cast("timestamp")

    merge_batch(table, arrived("a"), found("a", "b"), day(1), scope, "w", 0)
    merge_batch(table, arrived("c"), found("c", "b"), day(2), scope, "w", 1)
    merge_batch(table, arrived("c"), found(), day(3), scope, "w", 1)
    times = dict(rows(table.read(), "package", "ctime"))
    assert {n: t.day for n, t in times.items()} == {"a": 1, "b": 1, "c": 2}
    merge_batch(table, arrived("a"), found(), day(3), scope, "w", 2)
    assert rows(table.read(), "package") == [("b",), ("c",)] and table.last() == 2


def test_change_events_are_published_once(spark, tmp_path):
    log = index.change_log(spark, str(tmp_path / "log"))
    event = spark.createDataFrame([("c", "p", "a", "new", "", "1")], "comp string, pkg string, arch string, method string, from_ver string, to_ver string")
    assert [index.write_change_events(event, log, "w", b) for b in (0, 0, 1, 0)] == [0, 0, 1, 1]
    assert log.read().count() == 2 and '"method":"new"' in log.read(0).first().value


def test_inventory_upkeep(spark, make):
    known = make("packages", [
        {"filename": f, "size": s, "mtime": m, "sha256": h, "package": f, "version": "1", "repo": "r"}
        for f, s, m, h in (("same", 1, 1, "x"), ("touched", 1, 1, "h"), ("edited", 1, 1, "h"), ("grown", 1, 1, "x"), ("gone", 1, 1, "x"))])
    listing = spark.createDataFrame(
        [("same", 1, 1), ("touched", 1, 2), ("edited", 1, 2), ("grown", 2, 1), ("added", 1, 1)], "filename string, size bigint, mtime bigint")
    todo = ch.needs_digest(known, listing)
    assert rows(todo) == [("edited",), ("touched",)]
    digests = todo.withColumn("digest", F.when(F.col("filename") == "touched", "h").otherwise("z"))
    status = dict(rows(ch.diff_inventory(known, listing, digests), "filename", "status"))
    assert status == {"same": "unchanged", "touched": "unchanged", "edited": "replaced", "grown": "replaced", "gone": "deleted", "added": "added"}
    kept = ch.cascade_delete({"p": known}, known.filter("filename = 'gone'"))["p"]
    assert kept.count() == 4
    copies = make("packages", [{"package": "a", "version": "1", "repo": "r", "filename": f, "mtime": m} for f, m in (("x", 1), ("y", 3), ("z", 3))])
    packages, rest = ch.resolve_duplicates(copies)
    assert rows(packages, "filename") == [("z",)] and rows(rest, "filename") == [("x",), ("y",)]
    old = make("dependencies", [{"package": "a", "version": "1", "repo": "r", "relationship": k, "value": "o"} for k in ("Depends", "Breaks")])
    new = old.filter("relationship = 'Depends'").withColumn("value", F.lit("n"))
    assert rows(ch.upsert_dependencies(old, new), "relationship", "value") == [("Breaks", "o"), ("Depends", "n")]
    repos = make("repos", [{"name": "r", "path": "b/c"}, {"name": "s", "path": "b/d"}])
    gone = ch.missing_repos(repos, spark.createDataFrame([("b/d",)], "path string"))
    assert rows(gone) == [("b/c",)]
    assert ch.purge_repos({"p": known}, repos, gone)["p"].isEmpty()
    assert ch.purge_repos({"p": known}, repos, gone, dry_run=True)["p"].count() == 5
    assert ch.register_repos(repos, make("repos", [{"name": "r"}, {"name": "t"}])).count() == 3
    deleted = make("packages", [{"package": "a", "version": "1", "architecture": "x"}]).withColumns({"branch": F.lit("b"), "component": F.lit("c")})
    assert rows(ch.deletion_events(deleted)) == [("b-c", "a", "x", "delete", "1", "")]
