"""Registered queries: each operator over relations derived from the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.checks.fixtures import Fixtures
from poolscope.checks.oracles import (
    RELATION, finding, fullv, joinpath, js, matches, quoted, rule, srcdir, statement, vk,
)
from poolscope.functions import paths, relations, sonames, text, versions
from poolscope.operators import archive, catalogue, changes, lifecycle, stanzas
from poolscope.operators.detectors import (
    archives as da, collisions as dc, dependencies as dd, libraries as dl, sources as ds,
)
from poolscope.plans import views
from poolscope.plans.analyze import Tables, derive, detect_all
from poolscope.plans.commits import Committed
from poolscope.plans.gc import gc
from poolscope.plans.history import History
from poolscope.plans.pathindex import PathIndex
from poolscope.plans.publish import publish
from poolscope.plans.sizes import SizeCounts
from poolscope.plans.storage import fresh_path, stored
from poolscope.plans.sync import Source, sync
from poolscope.schemas import PACKAGE_KEY
from poolscope.sinks import index
from poolscope.sources import branches, inventory, snapshots
from poolscope.sources import stanzas as stanza_source
from poolscope.streaming.changes import stream_changes, stream_snapshot_merge

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CORE_TREE = "core-tree"
PLACEHOLDER = "Null Packager <null@example.org>"
NOW = "2020-01-01 00:00:00"
DETAILS = ("package", "version", "repo")


def query(name: str, sql: str | None = None, **local: str):
    def register(build: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE_SQL[name] = statement(sql, **local)
        return build

    return register


# ---- shared inputs -------------------------------------------------------

def packages(fx: Fixtures) -> DataFrame:
    return changes.with_version_key(fx.packages, strict=False)


def latest(fx: Fixtures) -> DataFrame:
    return catalogue.latest_packages(packages(fx))


def atoms(fx: Fixtures) -> DataFrame:
    return catalogue.dependency_atoms(fx.dependencies, latest(fx))


def breaks(fx: Fixtures) -> DataFrame:
    new = kept_latest(fx)
    fx.keep("sodep")
    return catalogue.soname_breaks(fx.sodep, new, fx.repos, fx.issues_prev)


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def text_of(*columns: str) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in columns]


def kept_packages(fx: Fixtures) -> DataFrame:
    """The package table, written once for queries that read it many times."""
    def written() -> DataFrame:
        kept = stored(packages(fx), "packages")
        fx.put("packages", kept.drop("vk"))
        return kept

    return fx.once("kept_packages", written)


def kept_latest(fx: Fixtures, every: DataFrame | None = None) -> DataFrame:
    """What the detectors on relations read of the latest packages, written once."""
    def written() -> DataFrame:
        new = latest(fx) if every is None else catalogue.latest_packages(every)
        return stored(new.select(*PACKAGE_KEY, "mtime", "vk"), "latest")

    return fx.once("kept_latest", written)


def kept_issues(fx: Fixtures) -> DataFrame:
    """The issues of the previous run, written once."""
    kept_packages(fx)
    fx.keep("sodep", "issues_prev")
    return fx.issues_prev


def detected_latest(fx: Fixtures) -> DataFrame:
    """The latest packages with what the detectors on files and relations read of them, written once."""
    read = [*PACKAGE_KEY, "filename", "size", "mtime", "debtime", "vk"]
    return fx.once("detected_latest", lambda: stored(catalogue.latest_packages(kept_packages(fx).select(*read)), "latest"))


def fresh_folder(fx: Fixtures, label: str) -> str:
    return fresh_path(fx.spark, label)


# ---- scalar functions ----------------------------------------------------

@query("version_key", f"SELECT DISTINCT version, {vk('version')} AS vk FROM fx_packages")
def _(fx):
    return fx.packages.select("version").distinct().withColumn(
        "vk", versions.version_key(F.col("version"))
    )


@query("version_key_checked", f"""
SELECT raw, CASE WHEN regexp_full_match(raw, '([0-9]+:)?[A-Za-z0-9.+~-]+') AND NOT regexp_matches(raw, '[1-9][0-9]{{26}}')
  THEN {vk('raw')} END AS vk FROM (
  SELECT DISTINCT version || CASE WHEN strpos(version, '+git') > 0 THEN '_bad'
    WHEN strpos(version, '~rc') > 0 THEN repeat('7', 26) ELSE '' END AS raw FROM fx_packages)""")
def _(fx):
    v = F.col("version")
    raw = F.concat(
        v,
        F.when(F.contains(v, F.lit("+git")), "_bad")
        .when(F.contains(v, F.lit("~rc")), F.repeat(F.lit("7"), F.lit(26))).otherwise(""),
    )
    return fx.packages.select(raw.alias("raw")).distinct().withColumn(
        "vk", versions.version_key(F.col("raw"), strict=True, longest=26)
    )


@query("version_key_long", f"""
SELECT raw, {vk('raw')} AS vk FROM (SELECT DISTINCT version || repeat('7', CASE length(version) % 4
  WHEN 0 THEN 27 WHEN 1 THEN 81 WHEN 2 THEN 209 ELSE 300 END) AS raw FROM fx_packages)""")
def _(fx):
    v = F.col("version")
    rest = F.length(v) % 4
    digits = F.when(rest == 0, 27).when(rest == 1, 81).when(rest == 2, 209).otherwise(300)
    raw = fx.packages.select(F.concat(v, F.repeat(F.lit("7"), digits)).alias("raw")).distinct()
    return raw.withColumn("vk", versions.version_key(F.col("raw"), strict=True))


_CMP = "CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END"


@query("compare_versions", f"""
SELECT left_version, right_version, {_CMP} AS cmp, CASE WHEN a <> b THEN {_CMP} WHEN left_version < right_version THEN -1
  WHEN left_version > right_version THEN 1 ELSE 0 END AS cmp_total
FROM (SELECT DISTINCT left_version, right_version, {vk('left_version')} AS a, {vk('right_version')} AS b FROM fx_version_pairs)""")
def _(fx):
    left, right = F.col("left_version"), F.col("right_version")
    return fx.version_pairs.select("left_version", "right_version").distinct().select(
        "left_version", "right_version",
        versions.compare_versions(left, right).alias("cmp"),
        versions.compare_versions_total(left, right).alias("cmp_total"),
    )


@query("version_matches", f"""
SELECT left_version, op, right_version, {matches('a', 'op', 'b')} AS ok
FROM (SELECT *, {vk('left_version')} AS a, {vk('right_version')} AS b FROM fx_version_pairs)""")
def _(fx):
    return fx.version_pairs.select(
        "left_version", "op", "right_version",
        versions.version_matches(
            versions.version_key(F.col("left_version")), F.col("op"),
            versions.version_key(F.col("right_version")),
        ).alias("ok"),
    )


@query("full_version", f"SELECT package, branch, {fullv('v')} AS full_version FROM fx_source_versions v")
def _(fx):
    return fx.source_versions.select(
        "package", "branch",
        versions.full_version(F.col("epoch"), F.col("version"), F.col("release")).alias("full_version"),
    )


@query("file_paths", f"""
SELECT f.package, f.version, f.repo, {joinpath('f')} AS filename, f.perm & 1 AS world_exec, f.perm & 2 AS world_write,
  f.perm & 64 AS owner_exec FROM fx_files f""")
def _(fx):
    bit = paths.permission_bit
    return fx.files.select(
        *PACKAGE_KEY, paths.join_path(F.col("path"), F.col("name")).alias("filename"),
        bit(F.col("perm"), 1).alias("world_exec"), bit(F.col("perm"), 2).alias("world_write"),
        bit(F.col("perm"), 64).alias("owner_exec"),
    )


@query("source_dir", f"SELECT name, {srcdir('s')} AS dir FROM fx_sources s")
def _(fx):
    return fx.sources.select(
        "name", paths.source_dir(F.col("category"), F.col("section"), F.col("directory")).alias("dir")
    )


@query("soname_satisfies", """
SELECT DISTINCT a.name, a.ver AS have, b.ver AS want, a.ver = b.ver OR starts_with(a.ver, b.ver || '.') AS ok
FROM (SELECT DISTINCT name, ver FROM fx_sodep WHERE depends = 0) a JOIN (SELECT DISTINCT name, ver FROM fx_sodep WHERE depends = 1) b ON a.name = b.name""")
def _(fx):
    have = fx.sodep.filter("depends = 0").select("name", F.col("ver").alias("have")).distinct()
    want = fx.sodep.filter("depends = 1").select("name", F.col("ver").alias("want")).distinct()
    return have.join(want, "name").withColumn(
        "ok", sonames.soname_satisfies(F.col("have"), F.col("want"))
    )


@query("expected_pool_filename", """
SELECT p.package, p.version, p.repo, 'pool/' || r.path || '/' || CASE WHEN p.package LIKE 'lib%' THEN substring(p.package, 1, 4) ELSE substring(p.package, 1, 1) END
    || '/' || p.package || '_' || regexp_replace(split_part(':' || p.version, ':', -1), '(-[A-Za-z0-9.+~]+)?$', '')
    || CASE WHEN strpos(p.version, '-') > 0 THEN '-' || split_part(p.version, '-', -1) ELSE '-0' END || '_'
    || CASE WHEN p.architecture = 'all' THEN 'noarch' ELSE p.architecture END || '.deb' AS expected
FROM fx_packages p JOIN fx_repos r ON r.name = p.repo""")
def _(fx):
    place = fx.repos.select(F.col("name").alias("repo"), "path")
    return fx.packages.join(place, "repo").select(
        *PACKAGE_KEY,
        paths.expected_pool_filename(
            F.col("package"), F.col("version"), F.col("architecture"), F.col("path")
        ).alias("expected"),
    )


# ---- sources -------------------------------------------------------------

@query("with_digest", """
SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents""")
def _(fx):
    return inventory.with_digest(fx.documents.select("doc_id", "text"), "text").drop("text")


@query("pool_coordinates", """
SELECT filename, split_part(filename, '/', 2) AS branch, split_part(filename, '/', 3) AS component,
  split_part(filename, '/', 2) || '/' || split_part(filename, '/', 3) AS path
FROM fx_packages WHERE split_part(filename, '/', 2) IN (SELECT branch FROM fx_tree_branches WHERE priority < 2)""")
def _(fx):
    configured = fx.tree_branches.filter("priority < 2").select("branch")
    return inventory.pool_coordinates(fx.packages.select("filename"), configured)


@query("parse_package_filename", """
SELECT filename, package, version, architecture FROM (
  SELECT p.filename, p.package, p.version, p.architecture FROM fx_packages p)""")
def _(fx):
    coded = F.replace(F.replace(F.col("filename"), F.lit("~"), F.lit("%7e")), F.lit(":"), F.lit("%3a"))
    package, version, arch = paths.parse_package_filename(coded)
    return fx.packages.select(
        "filename", package.alias("package"), version.alias("version"), arch.alias("architecture")
    )


@query("repo_name", """
SELECT name, CASE WHEN component = 'main' THEN '' ELSE component || '-' END || CASE WHEN architecture = 'all' THEN 'noarch' ELSE architecture END AS realname,
  CASE WHEN component = 'main' THEN '' ELSE component || '-' END || CASE WHEN architecture = 'all' THEN 'noarch' ELSE architecture END || '/' || branch AS repo
FROM fx_repos""")
def _(fx):
    arch, component = F.col("architecture"), F.col("component")
    return fx.repos.select(
        "name",
        paths.repo_realname(arch, component).alias("realname"),
        paths.repo_name(arch, component, F.col("branch")).alias("repo"),
    )


_STANZA_FIELDS = """
SELECT package, version, repo, 1 AS nr, 'Package' AS key, package AS value FROM fx_packages
UNION ALL SELECT package, version, repo, 2, 'VERSION', version FROM fx_packages
UNION ALL SELECT package, version, repo, 3, 'Architecture', architecture FROM fx_packages
UNION ALL SELECT package, version, repo, 4, 'Section', section FROM fx_packages WHERE section IS NOT NULL
UNION ALL SELECT package, version, repo, 5, 'Installed-Size', CAST(installed_size AS VARCHAR) FROM fx_packages
UNION ALL SELECT package, version, repo, 6, 'Maintainer', maintainer FROM fx_packages
UNION ALL SELECT package, version, repo, 7, 'Depends', 'libc (>= 2), ' || package || '-data' FROM fx_packages
UNION ALL SELECT package, version, repo, 8, 'Description', description || chr(10) || ' more text' || chr(10) || ' .' || chr(10) || ' end' FROM fx_packages"""


@query("read_stanzas", f"""
SELECT package, version, repo, row_number() OVER (PARTITION BY package, version, repo ORDER BY nr) AS nr, key, value
FROM ({_STANZA_FIELDS})""")
def _(fx):
    read = stanza_source.with_fields(fx.stanza_text, "text")
    return read.select(*PACKAGE_KEY, F.posexplode("entries").alias("nr", "e")).select(
        *PACKAGE_KEY, (F.col("nr") + 1).cast("bigint").alias("nr"), "e.key", "e.value"
    )


@query("read_stanzas_file", f"""
SELECT package, count(*) AS n, min(version) AS first_version FROM fx_packages GROUP BY package""")
def _(fx):
    folder = fresh_folder(fx, "stanzas")
    blank = F.when(F.length("package") % 2 == 0, F.lit("\n\n")).otherwise(F.lit("\n \t\n"))
    fx.stanza_text.select(F.concat("text", blank)).write.mode("overwrite").text(folder, lineSep="\n")
    read = stanza_source.read_stanzas(fx.spark, folder, ["Package", "Version"])
    return read.groupBy(F.col("fields")["package"].alias("package")).agg(
        F.count("*").alias("n"), F.min(F.col("fields")["version"]).alias("first_version")
    )


@query("read_stanzas_ranges", """
SELECT package, count(*) AS n, min(version) AS first_version, max(section) AS last_section FROM fx_packages GROUP BY package""")
def _(fx):
    """Files of both line ends, cut into ranges that end anywhere in a paragraph."""
    folder = fresh_folder(fx, "stanza-ranges")
    lf = F.concat("text", F.when(F.length("package") % 2 == 0, F.lit("\n\n")).otherwise(F.lit("\n \t\n")))
    windows = F.length("version") % 2 == 0
    fx.stanza_text.filter(~windows).select(lf).write.text(f"{folder}/lf", lineSep="\n")
    fx.stanza_text.filter(windows).select(F.replace(lf, F.lit("\n"), F.lit("\r\n"))).write.text(f"{folder}/crlf", lineSep="\r\n")
    read = stanza_source.read_stanzas(fx.spark, folder, ["Package", "Version", "Section"], range_bytes=100_003)
    return read.groupBy(F.col("fields")["package"].alias("package")).agg(
        F.count("*").alias("n"), F.min(F.col("fields")["version"]).alias("first_version"),
        F.max(F.col("fields")["section"]).alias("last_section"),
    )


@query("strip_clearsign", """
SELECT package, version, repo, 'Package: ' || package || chr(10) || 'Version: ' || version AS payload FROM fx_packages""")
def _(fx):
    payload = F.concat(F.lit("Package: "), "package", F.lit("\nVersion: "), "version")
    signed = F.concat(
        F.lit("-----BEGIN PGP SIGNED MESSAGE-----\nHash: SHA256\n\n"), payload,
        F.lit("\n\n-----BEGIN PGP SIGNATURE-----\n\niQ"), "filename",
        F.lit("\n-----END PGP SIGNATURE-----\n"),
    )
    body = F.when(F.length("package") % 2 == 0, signed).otherwise(payload)
    stripped = F.regexp_replace(stanza_source.strip_clearsign(body), r"\n+$", "")
    return fx.packages.select(*PACKAGE_KEY, stripped.alias("payload"))


@query("ingest_snapshot", "SELECT 7 AS tid, package, dependency, relop, version, relationship FROM fx_source_deps")
def _(fx):
    source = fx.source_deps.select("package", "dependency", "relop", "version", "relationship")
    target = fresh_folder(fx, "snapshot")
    return snapshots.ingest_snapshot(source, target, {"tid": F.lit(7)})


@query("changed_sources", """
SELECT l.name, l.etag FROM (SELECT name, branch AS etag FROM fx_repos) l
WHERE NOT EXISTS (SELECT 1 FROM (SELECT name, CASE WHEN testing = 0 THEN branch ELSE path END AS etag FROM fx_repos) c
  WHERE c.name = l.name AND c.etag IS NOT DISTINCT FROM l.etag)""")
def _(fx):
    listing = fx.repos.select("name", F.col("branch").alias("etag"))
    control = fx.repos.select(
        "name", F.when(F.col("testing") == 0, F.col("branch")).otherwise(F.col("path")).alias("etag")
    )
    return snapshots.changed_sources(listing, control)


@query("text_codec", r"""
SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), chr(13), '\r'), chr(10), '\n'), chr(9), '\t') AS line, text AS decoded FROM documents""")
def _(fx):
    line = text.encode_tab_text(F.col("text"))
    return fx.documents.select("doc_id", line.alias("line")).withColumn(
        "decoded", text.decode_tab_text(F.col("line"))
    )


@query("branch_dimension", """
SELECT branch, CASE WHEN branch = 'stable' THEN 'main-line' ELSE 'cn' END AS codename,
  CASE WHEN branch = 'stable' THEN '%BRANCH% as given' ELSE 'Branch ' || branch END AS "desc", 'lb' AS label, 'og' AS origin, 5 AS ttl
FROM (SELECT DISTINCT branch FROM fx_repos)""")
def _(fx):
    on_disk = fx.repos.select("branch").distinct()
    configured = on_disk.filter("branch = 'stable'").select(
        "branch", F.lit("main-line").alias("codename"), F.lit("%BRANCH% as given").alias("desc")
    )
    defaults = {"codename": "cn", "desc": "Branch %BRANCH%", "label": "lb", "origin": "og", "ttl": 5}
    return branches.branch_dimension(configured, defaults, on_disk).drop("renew_in")


# ---- package content -----------------------------------------------------

def entries(fx: Fixtures) -> DataFrame:
    return fx.entries.withColumn("needed", F.split("needs", ","))


_BASE = "split_part(path, '/', -1)"
_PLACE = "regexp_matches(path, '^\\./(usr/)?lib') AND NOT regexp_matches(path, '^\\./(usr/)?libexec') AND contains(path || '.', '.so.')"
_CANDIDATES = f"""
SELECT DISTINCT package, version, repo, soname FROM (
  SELECT package, version, repo, {_BASE} AS soname FROM fx_entries WHERE {_PLACE} AND (type = 40960 OR is_dyn)
  UNION ALL SELECT package, version, repo, soname FROM fx_entries WHERE {_PLACE} AND is_dyn AND type <> 40960)
WHERE soname <> ''"""
_PRIVATE = f"""
SELECT DISTINCT package, version, repo, soname FROM (
  SELECT package, version, repo, {_BASE} AS soname FROM fx_entries WHERE is_dyn
  UNION ALL SELECT package, version, repo, soname FROM fx_entries WHERE is_dyn) WHERE soname <> ''"""
_NEEDED = """
SELECT DISTINCT package, version, repo, unnest(string_split(needs, ',')) AS soname FROM fx_entries WHERE needs IS NOT NULL"""
_SAME = "b.package = a.package AND b.version = a.version AND b.repo = a.repo"


@query("normalize_files", """
SELECT package, version, repo, replace(regexp_replace(replace(replace(replace(substring(path, 3), '/./', '/'), '//', '/'), 'bin/../', ''), '/[^/]*$', ''), '', '') AS path,
  split_part(path, '/', -1) AS name, size,
  CASE type WHEN 40960 THEN 'lnk' WHEN 32768 THEN 'reg' WHEN 4096 THEN 'fifo' WHEN 16384 THEN 'dir' ELSE CAST(type AS VARCHAR) END AS ftype, perm
FROM fx_entries""")
def _(fx):
    return archive.normalize_files(entries(fx))


@query("split_soname", """
SELECT soname, CASE WHEN contains(soname, '.so') THEN regexp_extract(soname, '^(.*\\.so)', 1) ELSE soname END AS name,
  CASE WHEN contains(soname, '.so') THEN regexp_extract(soname, '^.*\\.so(.*)$', 1) ELSE '' END AS ver
FROM (SELECT DISTINCT split_part(path, '/', -1) AS soname FROM fx_entries)""")
def _(fx):
    soname = F.col("soname")
    return fx.entries.select(F.substring_index("path", "/", -1).alias("soname")).distinct().select(
        "soname", sonames.soname_name(soname).alias("name"), sonames.soname_version(soname).alias("ver")
    )


@query("soname_candidates", _CANDIDATES)
def _(fx):
    return archive.soname_candidates(entries(fx))


@query("private_provides", _PRIVATE)
def _(fx):
    return archive.private_provides(entries(fx))


@query("needed_sonames", _NEEDED)
def _(fx):
    return archive.needed_libraries(entries(fx))


@query("drop_short_sonames", f"""
SELECT a.* FROM ox_candidates a WHERE NOT EXISTS (
  SELECT 1 FROM ox_candidates b WHERE {_SAME} AND b.soname <> a.soname AND starts_with(b.soname, a.soname || '.'))""",
    ox_candidates=_CANDIDATES)
def _(fx):
    return archive.drop_short_sonames(archive.soname_candidates(entries(fx)))


@query("drop_self_resolved", f"""
SELECT a.* FROM ox_listed a WHERE NOT EXISTS (
  SELECT 1 FROM ox_private b WHERE {_SAME} AND starts_with(b.soname || '.', a.soname || '.'))""",
    ox_listed=_NEEDED, ox_private=_PRIVATE)
def _(fx):
    return archive.drop_self_resolved(
        archive.needed_libraries(entries(fx)), archive.private_provides(entries(fx))
    )


@query("control_to_package", f"""
SELECT package, version, architecture, section, CAST(installed_size AS BIGINT) AS installed_size, maintainer,
  description || chr(10) || ' more text' || chr(10) || ' .' || chr(10) || ' end' AS description, {vk('version')} AS vk FROM fx_packages""")
def _(fx):
    read = stanza_source.with_fields(fx.stanza_text, "text").select("fields")
    return archive.control_to_package(read)


@query("control_to_dependencies", """
SELECT package, version, repo, 'Depends' AS relationship, 'libc (>= 2), ' || package || '-data' AS value FROM fx_packages""")
def _(fx):
    return archive.control_to_dependencies(
        stanza_source.with_fields(fx.stanza_text, "text"), PACKAGE_KEY
    )


@query("corrupt_packages", """
SELECT filename, size, package, version, architecture, debtime IS NOT NULL AS valid FROM fx_packages""")
def _(fx):
    readable = fx.packages.filter("debtime IS NOT NULL").select(
        "filename", "size", "package", "version", "architecture", F.lit(1).cast("bigint").alias("debtime")
    )
    unread = archive.corrupt_packages(fx.packages.filter("debtime IS NULL").select("filename", "size"))
    return readable.unionByName(unread, allowMissingColumns=True).select(
        "filename", "size", "package", "version", "architecture", F.col("debtime").isNotNull().alias("valid")
    )


# ---- derived views -------------------------------------------------------

@query("latest_packages", "SELECT package, version, repo, architecture, filename, size, vk FROM ox_latest")
def _(fx):
    return latest(fx).select(*PACKAGE_KEY, "architecture", "filename", "size", "vk")


@query("dependency_atoms", "SELECT package, version, repo, relationship, CAST(nr AS INTEGER) AS nr, deppkg, deparch, relop, depver, depvk FROM ox_atoms")
def _(fx):
    return atoms(fx)


_BREAKS = ("package", "repo", "soname", "sover", "sodepver", "dep_package", "dep_repo", "dep_version")


@query("soname_breaks", f"SELECT {', '.join(_BREAKS)} FROM ox_breaks")
def _(fx):
    return breaks(fx)


@query("views_refreshed", """
SELECT 'latest' AS view, package, version, repo, filename AS a, CAST(NULL AS VARCHAR) AS b, CAST(NULL AS VARCHAR) AS c FROM ox_latest
UNION ALL SELECT 'atoms', package, version, repo, relationship || ' ' || CAST(nr AS VARCHAR), deppkg, depver FROM ox_atoms
UNION ALL SELECT 'breaks', package, sover, repo, soname, dep_package || ' ' || dep_repo || ' ' || sodepver, dep_version FROM ox_breaks""")
def _(fx):
    """Views of an earlier catalogue, refreshed by inserted, replaced and deleted packages."""
    every, s = kept_packages(fx), F.col("size")
    fx.keep("dependencies", "sodep")
    gone = changes.with_version_key(every.filter(s % 7 == 0).withColumn("version", F.concat("version", F.lit(".9"))), strict=False)
    fresh, replaced = every.filter(s % 13 == 0), every.filter((s % 11 == 0) & (s % 13 > 0))
    unreadable = F.when(s % 11 == 0, F.lit(None)).otherwise(F.col("debtime"))
    earlier = stored(every.filter(s % 13 > 0).withColumn("debtime", unreadable).unionByName(gone), "earlier-packages")
    dependencies, sodep = fx.dependencies, fx.sodep
    known = earlier.select(*PACKAGE_KEY)
    before = views.Sources(
        earlier, dependencies.join(known, PACKAGE_KEY, "left_semi"), sodep.join(known, PACKAGE_KEY, "left_semi"),
        fx.repos, fx.issues_prev,
    )
    after = views.Sources(every, dependencies, sodep, fx.repos, fx.issues_prev)
    changed_keys = fresh.select(*PACKAGE_KEY).unionByName(replaced.select(*PACKAGE_KEY)).unionByName(gone.select(*PACKAGE_KEY))
    mark = catalogue.max_modified(fx.repos)
    now_ = views.refresh(views.build(before), before, after, changed_keys, mark.withColumn("modified", F.col("modified") - 1), mark)
    none = F.lit(None).cast("string")
    return now_.latest.select(F.lit("latest").alias("view"), *PACKAGE_KEY, F.col("filename").alias("a"), none.alias("b"), none.alias("c")).union(
        now_.atoms.select(F.lit("atoms"), *PACKAGE_KEY, F.concat_ws(" ", "relationship", F.col("nr").cast("string")), "deppkg", "depver")
    ).union(
        now_.breaks.select(
            F.lit("breaks"), "package", "sover", "repo", "soname", F.concat_ws(" ", "dep_package", "dep_repo", "sodepver"), "dep_version"
        )
    )


@query("soname_break_order", """
SELECT p.package, p.dep_package, coalesce(string_agg(o.dep_package, ' ' ORDER BY o.dep_package) FILTER (WHERE d.later IS NOT NULL), '') AS deplist
FROM ox_pairs p JOIN ox_pairs o USING (package)
LEFT JOIN (SELECT package AS later, dependency AS earlier FROM fx_source_deps WHERE relationship IN ('BUILDDEP', 'PKGDEP')
  UNION SELECT dep_package, package FROM ox_pairs) d
  ON d.later = o.dep_package AND d.earlier = p.dep_package AND o.dep_package <> p.dep_package
GROUP BY ALL""")
def _(fx):
    order = catalogue.soname_break_order(stored(breaks(fx), "breaks"), fx.source_deps)
    return order.withColumn("deplist", F.array_join("deplist", " "))


@query("source_packages", "SELECT * REPLACE (CAST(commit_time AS BIGINT) AS commit_time) FROM ox_source_packages")
def _(fx):
    return catalogue.source_packages(fx.sources, fx.trees, fx.source_versions).withColumn(
        "commit_time", F.col("commit_time").cast("bigint")
    )


@query("upstream_versions", """
SELECT package, coalesce(u.version, k.latest_version) AS version, CAST(coalesce(u.time, k.updated_on) AS BIGINT) AS updated,
  coalesce(u.url, format('https://example.org/project/{}/', k.id)) AS url, u.tarball
FROM fx_upstream u FULL JOIN (SELECT l.package, j.id, j.latest_version, j.updated_on FROM fx_upstream_links l
  LEFT JOIN fx_upstream_projects j ON j.id = l.projectid) k USING (package)""")
def _(fx):
    return catalogue.upstream_versions(
        fx.upstream, fx.upstream_links, fx.upstream_projects, "https://example.org/project/{id}/"
    ).withColumn("updated", F.col("updated").cast("bigint"))


@query("repo_modified", """
SELECT r.name, CAST(coalesce(r.mtime, m.t) AS VARCHAR) AS mtime FROM fx_repos r LEFT JOIN (SELECT repo, max(mtime) AS t FROM fx_packages GROUP BY repo) m ON m.repo = r.name""")
def _(fx):
    return catalogue.repo_modified(fx.repos, fx.packages).select("name", *text_of("mtime"))


@query("max_modified", """
SELECT branch, CAST(coalesce(epoch(max(mtime)), 0) AS BIGINT) AS modified FROM fx_repos GROUP BY branch
UNION ALL SELECT NULL, CAST(coalesce(epoch(max(mtime)), 0) AS BIGINT) FROM fx_repos""")
def _(fx):
    """Of every branch, and of all repositories in a row without a branch."""
    overall = catalogue.max_modified(fx.repos).select(F.lit(None).cast("string").alias("branch"), "modified")
    return catalogue.branch_modified(fx.repos).unionByName(overall)


@query("branch_modified", """
SELECT branch, CAST(coalesce(epoch(max(mtime)), 0) AS BIGINT) AS modified FROM fx_repos GROUP BY branch""")
def _(fx):
    return catalogue.branch_modified(fx.repos)


@query("seen_paths", "SELECT DISTINCT path FROM fx_repos")
def _(fx):
    return catalogue.seen_paths(fx.repos)


for _rule in ("dependency", "collision", "soname"):

    @query(f"compatible_repos_{_rule}", f"""
SELECT u.name AS repo, p.name AS provider, p.testing AS provider_testing FROM fx_repos u JOIN fx_repos p ON {rule(_rule, 'u', 'p')}""")
    def _(fx, _rule=_rule):
        return catalogue.compatible_repos(fx.repos, _rule)


@query("reverse_use_count", "SELECT name, package, cnt FROM ox_usage")
def _(fx):
    return catalogue.reverse_use_count(fx.sodep, fx.source_deps)


def closure(fx: Fixtures, broken: DataFrame) -> DataFrame:
    source = catalogue.source_packages(fx.sources, fx.trees, fx.source_versions)
    return dl.dependency_closure(dl.satisfied_edges(fx.source_deps, source), broken)


@query("dependency_closure", "SELECT package, dependency, sodep FROM ox_closure")
def _(fx):
    return closure(fx, breaks(fx))


# ---- detectors -----------------------------------------------------------

def _all(number: int | str) -> str:
    return f"SELECT package, version, repo, errno, level, filename, detail FROM ox_{number}"


@query("i101", _all(101))
def _(fx):
    return ds.detect_101(fx.basherr, fx.package_rel, fx.marks, fx.trees, fx.source_versions, fx.sources)


@query("i102", _all(102))
def _(fx):
    return ds.detect_102(fx.basherr, fx.package_rel, fx.marks, fx.trees, fx.source_versions, fx.sources)


@query("i103", _all(103))
def _(fx):
    return ds.detect_103(fx.sources, fx.source_versions, fx.tree_branches)


@query("i301", _all(301))
def _(fx):
    return da.detect_301(fx.packages)


@query("i302", _all(302))
def _(fx):
    every = kept_packages(fx)
    return da.detect_302(every, catalogue.latest_packages(every))


@query("i302_changed", _all(302) + " SEMI JOIN ox_new_latest USING (package, version, repo)")
def _(fx):
    """Medians over all rows from stored counts: a scan, recorded twice, brings rows and replaces some."""
    every = kept_packages(fx)
    arrived = lifecycle.changed_since(every, kept_issues(fx))
    earlier = every.join(arrived.select("filename"), "filename", "left_anti")
    replaced = arrived.withColumn("size", F.col("size") + 7)
    sizes = SizeCounts(fx.spark, fresh_folder(fx, "sizes"), 16)
    sizes.record(earlier.unionByName(replaced), writer="scan", batch=0)
    for _ in range(2):
        sizes.record(arrived, replaced, "scan", 1)
    fresh = stored(lifecycle.changed_since(detected_latest(fx), kept_issues(fx)), "changed-latest")
    return da.detect_302(arrived, fresh, sizes.medians(fresh))


@query("i303", _all(303))
def _(fx):
    return da.detect_303(fx.packages, fx.repos)


@query("i311", _all(311))
def _(fx):
    return da.detect_311(
        latest(fx), fx.repos, fx.sources, fx.tree_branches, fx.source_versions, PLACEHOLDER
    )


@query("i321", _all(321))
def _(fx):
    return da.detect_321(fx.files, latest(fx), exempt=("pkg1",))


@query("i322", _all(322))
def _(fx):
    return da.detect_322(fx.files, latest(fx))


@query("i323", _all(323))
def _(fx):
    return da.detect_323(fx.files, latest(fx))


@query("i324", _all(324))
def _(fx):
    return da.detect_324(fx.files, latest(fx))


@query("i401", _all(401))
def _(fx):
    return ds.detect_401(fx.sources, fx.source_versions, fx.tree_branches, fx.source_deps)


@query("i401_strict", _all("401_strict"))
def _(fx):
    return ds.detect_401(fx.sources, fx.source_versions, fx.tree_branches, fx.source_deps, True)


@query("i402", _all(402))
def _(fx):
    return ds.detect_402(fx.sources, fx.source_dups, fx.trees, fx.source_versions)


@query("i411", _all(411))
def _(fx):
    new = kept_latest(fx)
    return dd.detect_411(catalogue.dependency_atoms(fx.dependencies, new), new, fx.repos)


@query("i411_strict", _all("411_strict"))
def _(fx):
    new = kept_latest(fx)
    return dd.detect_411(catalogue.dependency_atoms(fx.dependencies, new), new, fx.repos, strict_compat=True)


@query("i411_or_groups", f"""
SELECT d.package, d.version, d.repo, 411 AS errno, min(CASE WHEN d.relationship <> 'Depends' THEN 1 ELSE 0 END) AS level, d.deppkg AS filename,
  {js(relationship='min(d.relationship)', relop='min(d.relop)', version='min(d.depver)')} AS detail
FROM (SELECT *, bool_or(met) OVER (PARTITION BY package, version, repo, relationship, nr) AS any_met FROM (
  SELECT d.*, EXISTS (SELECT 1 FROM ox_latest v2 JOIN fx_repos r2 ON r2.name = v2.repo WHERE v2.package = d.deppkg AND v2.package <> d.package
    AND {rule('dependency', 'd', 'r2')} AND (d.deparch IS NULL OR d.deparch = r2.architecture) AND {matches('v2.vk', 'd.relop', 'd.depvk')}) AS met
  FROM (SELECT a.*, r.architecture, r.component, r.testing FROM ox_atoms a JOIN fx_repos r ON r.name = a.repo
    WHERE relationship IN ('Depends', 'Pre-Depends', 'Recommends', 'Suggests')) d)) d
WHERE NOT any_met GROUP BY d.package, d.version, d.repo, d.deppkg""")
def _(fx):
    new = kept_latest(fx)
    return dd.detect_411(catalogue.dependency_atoms(fx.dependencies, new), new, fx.repos, or_groups=True)


@query("i412", _all(412))
def _(fx):
    return da.detect_412(fx.duplicates, fx.packages)


@query("i421", _all(421))
def _(fx):
    new = kept_latest(fx)
    return dc.detect_421(fx.files, new, fx.repos, catalogue.dependency_atoms(fx.dependencies, new))


@query("i421_changed", _all("421_changed"))
def _(fx):
    new = kept_latest(fx, kept_packages(fx))
    return dc.detect_421(
        fx.files, new, fx.repos, catalogue.dependency_atoms(fx.dependencies, new),
        lifecycle.changed_since(new, fx.issues_prev),
    )


@query("i421_indexed", _all("421_changed"))
def _(fx):
    """The other owners come from a stored index; the changed packages replace files of their own."""
    new = kept_latest(fx, kept_packages(fx))
    fx.keep("files")
    changed = stored(lifecycle.changed_since(new, fx.issues_prev), "changed-latest")
    own = changed.select(*PACKAGE_KEY)
    arrived = stored(fx.files.join(own, PACKAGE_KEY, "left_semi"), "arrived-files")
    earlier = fx.files.join(own, PACKAGE_KEY, "left_anti")
    replaced = arrived.withColumns({"path": F.lit("usr/bin"), "name": F.lit("README")})
    paths = PathIndex(fx.spark, fresh_folder(fx, "paths"), buckets=64, bits=1 << 16)
    paths.record(earlier.unionByName(replaced), writer="scan", batch=0)
    owners = stored(paths.touched_owners(arrived, replaced), "touched-owners")
    for _ in range(2):
        paths.record(arrived, replaced, "scan", 1)
    return dc.detect_421(owners, new, fx.repos, catalogue.dependency_atoms(fx.dependencies, new), changed)


@query("i431", _all(431))
def _(fx):
    new = kept_latest(fx)
    fx.together("sodep")
    return dl.detect_431(fx.sodep, new, fx.repos, fx.source_deps)


@query("i431_strict", _all("431_strict"))
def _(fx):
    new = kept_latest(fx)
    fx.together("sodep")
    return dl.detect_431(fx.sodep, new, fx.repos, fx.source_deps, strict_compat=True)


@query("i432", _all(432))
def _(fx):
    new = kept_latest(fx)
    fx.keep("sodep", "sources", "source_deps")
    broken = stored(catalogue.soname_breaks(fx.sodep, new, fx.repos, fx.issues_prev), "breaks")
    return dl.detect_432(
        broken, closure(fx, broken), new, new, fx.repos, fx.sources, fx.sodep, fx.source_deps, CORE_TREE
    )


def tables(fx: Fixtures) -> Tables:
    every = kept_packages(fx)
    fx.keep("dependencies", "sodep", "files", "sources", "source_versions", "source_deps", "issues_prev")
    return Tables(
        repos=fx.repos, packages=every, duplicates=fx.duplicates,
        dependencies=fx.dependencies, sodep=fx.sodep, files=fx.files, issues=fx.issues_prev,
        trees=fx.trees, tree_branches=fx.tree_branches, sources=fx.sources,
        source_dups=fx.source_dups, source_versions=fx.source_versions,
        source_deps=fx.source_deps, marks=fx.marks, package_rel=fx.package_rel, basherr=fx.basherr,
    )


_NUMBERS = (101, 102, 103, 301, 302, 303, 311, 321, 322, 323, 324, 401, 402, 411, 412, 421, 431, 432)


@query("detect_all", "SELECT errno, level, repo, count(*) AS n, count(detail) AS details, max(package || ' ' || version || ' ' || coalesce(filename, '')) AS last FROM ("
       + " UNION ALL ".join(_all(n) for n in _NUMBERS) + ") GROUP BY errno, level, repo")
def _(fx):
    t = tables(fx)
    views = derive(t, full=True)
    found = detect_all(t, views, core_tree=CORE_TREE, placeholder=PLACEHOLDER, exempt=("pkg1",))
    return found.groupBy("errno", "level", "repo").agg(
        F.count("*").alias("n"), F.count("detail").alias("details"),
        F.max(
            F.concat("package", F.lit(" "), "version", F.lit(" "), F.coalesce("filename", F.lit("")))
        ).alias("last"),
    )


# ---- issue life-cycle ----------------------------------------------------

_ISSUE = "package, version, repo, errno, level, filename, CAST(ctime AS VARCHAR) AS ctime, CAST(mtime AS VARCHAR) AS mtime, CAST(atime AS VARCHAR) AS atime, detail"


def shown(issues: DataFrame, *more: str) -> DataFrame:
    return issues.select(
        *DETAILS, "errno", "level", "filename", *text_of("ctime", "mtime", "atime"), "detail", *more
    )


def found(fx: Fixtures) -> DataFrame:
    """Findings to merge: corrupt, undersized and unmet-soname issues."""
    fx.keep("sodep")
    every, new = kept_packages(fx), detected_latest(fx)
    return stored(
        da.detect_301(every).unionByName(da.detect_302(every, new))
        .unionByName(dl.detect_431(fx.sodep, new, fx.repos, fx.source_deps)),
        "findings",
    )


def changed(fx: Fixtures) -> DataFrame:
    return lifecycle.changed_since(kept_packages(fx), kept_issues(fx))


_FOUND = " UNION ALL ".join(_all(n) for n in (301, 302, 431))
_KEYED = " AND ".join(f"i.{c} IS NOT DISTINCT FROM f.{c}" for c in ("package", "version", "repo", "errno", "filename"))
_TOUCHED = """(i.errno < 200 OR i.errno IN (401, 402, 411, 431) OR EXISTS (SELECT 1 FROM ox_new_packages p
  WHERE p.package = i.package AND p.version = i.version AND p.repo = i.repo))"""
_NOW = f"TIMESTAMP '{NOW}'"


@query("purge_stale", f"""
SELECT {_ISSUE} FROM fx_issues_prev i WHERE CASE WHEN EXISTS (SELECT 1 FROM fx_tree_branches b WHERE b.name = i.repo)
  THEN EXISTS (SELECT 1 FROM fx_tree_branches b JOIN fx_source_versions v ON v.branch = b.branch WHERE b.name = i.repo AND v.package = i.package AND i.version = {fullv('v')})
  ELSE i.errno NOT IN (301, 402, 412) AND EXISTS (SELECT 1 FROM ox_latest l WHERE l.package = i.package AND l.version = i.version AND l.repo = i.repo) END""")
def _(fx):
    return shown(
        lifecycle.purge_stale(fx.issues_prev, latest(fx), fx.tree_branches, fx.source_versions)
    )


@query("changed_since", "SELECT package, version, repo, CAST(mtime AS VARCHAR) AS mtime FROM ox_new_packages")
def _(fx):
    return changed(fx).select(*PACKAGE_KEY, *text_of("mtime"))


@query("touched", f"SELECT {_ISSUE} FROM fx_issues_prev i WHERE {_TOUCHED}")
def _(fx):
    return shown(lifecycle.touched(kept_issues(fx), changed(fx)))


@query("retire", f"SELECT {_ISSUE} FROM fx_issues_prev i WHERE {_TOUCHED} AND NOT EXISTS (SELECT 1 FROM ({_FOUND}) f WHERE {_KEYED})")
def _(fx):
    return shown(lifecycle.retire(lifecycle.touched(kept_issues(fx), changed(fx)), found(fx)))


@query("refresh", f"SELECT {_ISSUE.replace('CAST(atime AS VARCHAR)', f'CAST({_NOW} AS VARCHAR)')} FROM fx_issues_prev i WHERE {_TOUCHED}")
def _(fx):
    return shown(lifecycle.refresh(lifecycle.touched(kept_issues(fx), changed(fx)), now()))


@query("update_changed", f"""
SELECT i.package, i.version, i.repo, i.errno, f.level, i.filename, CAST(i.ctime AS VARCHAR) AS ctime, CAST({_NOW} AS VARCHAR) AS mtime,
  CAST(i.atime AS VARCHAR) AS atime, f.detail FROM fx_issues_prev i JOIN ({_FOUND}) f ON {_KEYED}
WHERE NOT (i.level = f.level AND i.detail IS NOT DISTINCT FROM f.detail)""")
def _(fx):
    return shown(lifecycle.update_changed(kept_issues(fx), found(fx), now()))


@query("insert_new", f"""
SELECT f.package, f.version, f.repo, f.errno, f.level, f.filename, CAST({_NOW} AS VARCHAR) AS ctime, CAST({_NOW} AS VARCHAR) AS mtime,
  CAST({_NOW} AS VARCHAR) AS atime, f.detail FROM ({_FOUND}) f WHERE NOT EXISTS (SELECT 1 FROM fx_issues_prev i WHERE {_KEYED})""")
def _(fx):
    return shown(lifecycle.insert_new(kept_issues(fx), found(fx), now()))


_MERGED = f"""
SELECT coalesce(i.package, f.package) AS package, coalesce(i.version, f.version) AS version, coalesce(i.repo, f.repo) AS repo,
  coalesce(i.errno, f.errno) AS errno, CASE WHEN f.errno IS NULL THEN i.level ELSE f.level END AS level, coalesce(i.filename, f.filename) AS filename,
  coalesce(i.ctime, {_NOW}) AS ctime,
  CASE WHEN i.errno IS NULL OR (f.errno IS NOT NULL AND NOT (i.level = f.level AND i.detail IS NOT DISTINCT FROM f.detail)) THEN {_NOW} ELSE i.mtime END AS mtime,
  CASE WHEN i.errno IS NULL OR i.hit THEN {_NOW} ELSE i.atime END AS atime,
  CASE WHEN f.errno IS NULL THEN i.detail ELSE f.detail END AS detail
FROM (SELECT i.*, {_TOUCHED} AS hit FROM fx_issues_prev i) i FULL JOIN ({_FOUND}) f ON {_KEYED}
WHERE f.errno IS NOT NULL OR NOT i.hit"""


@query("merge_issues", f"SELECT {_ISSUE} FROM ({_MERGED})")
def _(fx):
    return shown(lifecycle.merge_issues(kept_issues(fx), found(fx), changed(fx), now()))


_STATS = """
SELECT coalesce(c.repo, '') AS repo, coalesce(c.errno, 0) AS errno, c.cnt, t.total
FROM (SELECT repo, errno, count(DISTINCT package) AS cnt FROM fx_issues_prev GROUP BY CUBE (repo, errno)) c
LEFT JOIN (SELECT repo, arg_min(n, choice) AS total FROM (
    SELECT 1 AS choice, b.name AS repo, count(DISTINCT v.package) AS n FROM fx_tree_branches b JOIN fx_sources p USING (tree)
    JOIN fx_source_versions v ON (v.package, v.branch) = (p.name, b.branch) GROUP BY ROLLUP (b.name)
    UNION ALL SELECT 2, repo, count(package) FROM ox_latest GROUP BY ROLLUP (repo)) GROUP BY repo) t
  ON t.repo IS NOT DISTINCT FROM c.repo"""


def stats(fx: Fixtures) -> DataFrame:
    return lifecycle.issue_stats(
        fx.issues_prev, latest(fx), fx.sources, fx.source_versions, fx.tree_branches
    )


@query("issue_stats", _STATS)
def _(fx):
    return stats(fx)


@query("append_if_changed", """
SELECT repo, errno, cnt, total FROM ox_stats st ANTI JOIN (
  SELECT * FROM ox_history QUALIFY row_number() OVER (PARTITION BY repo, errno ORDER BY updated DESC) = 1) q
  ON q.repo = st.repo AND q.errno = st.errno AND q.cnt = st.cnt AND q.total IS NOT DISTINCT FROM st.total""",
    ox_stats=_STATS, ox_history="""
SELECT repo, errno, cnt, total, -1 AS updated FROM ox_stats
UNION ALL SELECT repo, errno, cnt + errno % 2, total, errno % 2 FROM ox_stats""")
def _(fx):
    st = stored(stats(fx), "stats")
    older = st.withColumn("updated", F.lit(-1).cast("bigint"))
    shift = (F.col("errno") % 2).cast("bigint")
    newer = st.withColumn("cnt", F.col("cnt") + shift).withColumn("updated", shift)
    return lifecycle.append_if_changed(older.unionByName(newer), st)


_SAID = [dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 20), dt.datetime(2020, 3, 5)]
_ASKED = [dt.datetime(2020, 1, 20) - dt.timedelta(seconds=1), dt.datetime(2020, 2, 1), dt.datetime(2020, 3, 5)]


@query("stats_as_of", """
SELECT 0 AS asked, repo, errno, cnt, total, '2020-01-01 00:00:00' AS since FROM ox_stats
UNION ALL SELECT 1, repo, errno, cnt + errno % 2, total, CASE WHEN errno % 2 = 1 THEN '2020-01-20 00:00:00' ELSE '2020-01-01 00:00:00' END FROM ox_stats
UNION ALL SELECT 2, repo, errno, cnt + errno % 2, total, CASE WHEN errno % 2 = 1 THEN '2020-01-20 00:00:00' ELSE '2020-01-01 00:00:00' END FROM ox_stats WHERE errno % 3 <> 0""",
    ox_stats=_STATS)
def _(fx):
    """Statistics recorded three times, the second time twice; then asked for at three times."""
    st = stored(stats(fx), "stats")
    more = st.withColumn("cnt", F.col("cnt") + F.col("errno") % 2)
    history = History(fx.spark, fresh_folder(fx, "stats-history"), st.schema, ("repo", "errno"))
    for batch, said in ((0, st), (1, more), (1, more), (2, more.filter("errno % 3 <> 0"))):
        history.record(said, F.lit(str(_SAID[batch])), "stats", batch)
    held = [history.as_of(t).withColumn("asked", F.lit(i)) for i, t in enumerate(_ASKED)]
    return held[0].unionByName(held[1]).unionByName(held[2]).select(
        "asked", "repo", "errno", "cnt", "total", F.col("valid_from").cast("string").alias("since")
    )


# ---- changes and catalogue upkeep ----------------------------------------

_DIFF = """
SELECT coalesce(k.filename, l.filename) AS filename, CASE WHEN l.filename IS NULL THEN 'deleted' WHEN k.filename IS NULL THEN 'added'
  WHEN k.size = l.size AND {same} THEN 'unchanged' ELSE 'replaced' END AS status, l.size
FROM (SELECT filename, size, mtime FROM fx_packages UNION ALL SELECT filename, size, mtime FROM fx_duplicates) k
FULL JOIN fx_listing l ON l.filename = k.filename"""


def known_files(fx: Fixtures) -> DataFrame:
    cols = ["filename", "size", "mtime"]
    return fx.packages.select(*cols).unionByName(fx.duplicates.select(*cols))


@query("diff_inventory", _DIFF.format(same="k.mtime = l.mtime"))
def _(fx):
    return changes.diff_inventory(known_files(fx), fx.listing).drop("mtime")


@query("diff_inventory_digest", _DIFF.format(same="(k.mtime = l.mtime OR strpos(k.filename, 'lib') > 0)"))
def _(fx):
    digest = F.sha2("filename", 256)
    known = known_files(fx).withColumn(
        "sha256", F.when(F.contains("filename", F.lit("lib")), digest).otherwise("other")
    )
    wanted = changes.needs_digest(known, fx.listing)
    return changes.diff_inventory(
        known, fx.listing, wanted.withColumn("digest", digest)
    ).drop("mtime")


@query("cascade_delete", """
SELECT 'dependencies' AS tab, count(*) AS n FROM fx_dependencies d WHERE NOT EXISTS (SELECT 1 FROM fx_packages p WHERE p.package = d.package AND p.version = d.version AND p.repo = d.repo AND p.debtime IS NULL)
UNION ALL SELECT 'sodep', count(*) FROM fx_sodep d WHERE NOT EXISTS (SELECT 1 FROM fx_packages p WHERE p.package = d.package AND p.version = d.version AND p.repo = d.repo AND p.debtime IS NULL)
UNION ALL SELECT 'files', count(*) FROM fx_files d WHERE NOT EXISTS (SELECT 1 FROM fx_packages p WHERE p.package = d.package AND p.version = d.version AND p.repo = d.repo AND p.debtime IS NULL)
UNION ALL SELECT 'duplicates', count(*) FROM fx_duplicates d WHERE NOT EXISTS (SELECT 1 FROM fx_packages p WHERE p.package = d.package AND p.version = d.version AND p.repo = d.repo AND p.debtime IS NULL)""")
def _(fx):
    kept = changes.cascade_delete(
        {"dependencies": fx.dependencies, "sodep": fx.sodep, "files": fx.files, "duplicates": fx.duplicates},
        fx.packages.filter("debtime IS NULL"),
    )
    counts = [df.agg(F.lit(n).alias("tab"), F.count("*").alias("n")) for n, df in kept.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


_CLASSIFIED = f"""
SELECT q.*, CASE WHEN prev IS NULL THEN 'new' WHEN nr > 1 THEN 'duplicate' WHEN vk > prev.vk OR (vk = prev.vk AND version > prev.version) THEN 'upgrade' ELSE 'old' END AS method
FROM (SELECT package, repo, event_id, version, branch, component, architecture, vk,
    max({{'vk': vk, 'version': version}}) OVER (PARTITION BY package, repo ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
    row_number() OVER (PARTITION BY package, repo, version ORDER BY event_id) AS nr
  FROM (SELECT *, {vk('version')} AS vk FROM fx_change_arrivals)) q"""
_FROM = "CASE method WHEN 'new' THEN '' WHEN 'duplicate' THEN version ELSE prev.version END"


@query("classify_changes", f"SELECT package, repo, event_id, version, method, {_FROM} AS from_ver, version AS to_ver FROM ({_CLASSIFIED})")
def _(fx):
    return changes.classify_changes(fx.change_arrivals, order="event_id").drop(
        "branch", "component", "architecture"
    )


_PUBLISHED = f"""
SELECT branch || '-' || component AS comp, package AS pkg, architecture AS arch, method, {_FROM} AS from_ver, version AS to_ver
FROM ({_CLASSIFIED}) WHERE method IN ('new', 'upgrade')"""


@query("published_changes", _PUBLISHED)
def _(fx):
    return changes.published_changes(changes.classify_changes(fx.change_arrivals, order="event_id"))


@query("change_messages", f"SELECT {js(comp='comp', pkg='pkg', arch='arch', method='method', from_ver='from_ver', to_ver='to_ver')} AS value FROM ({_PUBLISHED})")
def _(fx):
    return index.change_messages(
        changes.published_changes(changes.classify_changes(fx.change_arrivals, order="event_id"))
    )


def _slices(fx: Fixtures, rows: DataFrame, slice_: Column, n: int, label: str):
    """The rows as ``n`` deliveries to one folder; yields the folder after each."""
    folder = fresh_folder(fx, label)
    rows = stored(rows.withColumn("_slice", slice_), label + "-rows")
    for k in range(n):
        rows.filter(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(folder)
        yield folder


@query("stream_changes", _PUBLISHED)
def _(fx):
    """Three deliveries in order of arrival; the stream is started anew for each."""
    arrivals = fx.change_arrivals
    most = arrivals.agg(F.max("event_id").alias("m")).scalar()
    target = fresh_folder(fx, "stream")
    for folder in _slices(fx, arrivals, F.floor(F.col("event_id") * 3 / (most + 1)), 3, "stream-arrivals"):
        stream = fx.spark.readStream.schema(arrivals.schema).parquet(folder)
        stream_changes(stream, target, order="event_id").awaitTermination()
    return fx.spark.read.parquet(f"{target}/events")


@query("committed_change_events", f"""
SELECT 'all' AS readers, value FROM ({ORACLE_SQL["change_messages"]}) UNION ALL
SELECT 'pinned', {js(comp='comp', pkg='pkg', arch='arch', method='method', from_ver='from_ver', to_ver='to_ver')} FROM ({_PUBLISHED}) WHERE length(pkg) % 3 < 2""")
def _(fx):
    """Three batches of messages, two of them sent twice; one reader keeps the commit after the second."""
    events = stored(
        changes.published_changes(changes.classify_changes(fx.change_arrivals, order="event_id")), "events"
    )
    log = index.change_log(fx.spark, fresh_folder(fx, "change-log"))
    for batch in (0, 1, 1, 2, 0):
        index.write_change_events(events.filter(F.length("pkg") % 3 == batch), log, "changes", batch)
    return log.read().select(F.lit("all").alias("readers"), "value").unionByName(
        log.read(1).select(F.lit("pinned").alias("readers"), "value")
    )


_BATCH_TIME = "TIMESTAMP '2020-01-01' + to_days(CAST({} AS INTEGER))"


@query("stream_snapshot_merge", f"""
SELECT f.package, f.version, f.repo, f.errno, f.level, f.filename, CASE WHEN f.errno = 421 THEN NULL ELSE f.detail END AS detail,
  CAST(CASE WHEN f.errno = 421 THEN NULL WHEN f.errno = 431 THEN coalesce(i.ctime, {_BATCH_TIME.format(0)}) ELSE {_BATCH_TIME.format("p.size % 3")} END AS VARCHAR) AS ctime
FROM ({" UNION ALL ".join(_all(n) for n in (301, 303, 421, 431))}) f
LEFT JOIN fx_issues_prev i ON {_KEYED}
LEFT JOIN fx_packages p ON p.package = f.package AND p.version = f.version AND p.repo = f.repo
UNION ALL SELECT package, version, repo, errno, level, filename, detail, CAST(ctime AS VARCHAR) FROM fx_issues_prev WHERE errno = 302""")
def _(fx):
    """Three deliveries of packages; the second batch fails once before its commit and runs again."""
    every = kept_packages(fx)
    new = kept_latest(fx, every)
    fx.keep("sodep", "files", "issues_prev")
    unmet = stored(dl.detect_431(fx.sodep, new, fx.repos, fx.source_deps), "unmet")
    needed = stored(catalogue.dependency_atoms(fx.dependencies, new), "atoms")
    scope = lifecycle.Scope(whole=frozenset({431}), changed=frozenset({301, 303, 421}))
    table = Committed(fx.spark, fresh_folder(fx, "issue-table"), fx.issues_prev.schema, ("package",), 8)
    table.append(fx.issues_prev.filter("errno IN (302, 431)"))
    lost = [1]

    def detect(rows: DataFrame) -> DataFrame:
        arrived = rows.select(*every.columns)
        fresh = new.join(arrived.select(*PACKAGE_KEY), PACKAGE_KEY, "left_semi")
        return (
            da.detect_301(arrived).unionByName(da.detect_303(arrived, fx.repos))
            .unionByName(dc.detect_421(fx.files, new, fx.repos, needed, fresh)).unionByName(unmet)
        )

    def at(batch: int) -> Column:
        if batch in lost:
            lost.remove(batch)
            raise RuntimeError("this batch is lost")
        return F.lit(f"2020-01-0{batch + 1}").cast("timestamp_ntz")

    checkpoint = fresh_folder(fx, "merge-checkpoint")
    for folder in _slices(fx, every, F.col("size") % 3, 3, "merge-arrivals"):
        for _ in range(2):
            stream = fx.spark.readStream.schema(every.schema).parquet(folder)
            query_ = stream_snapshot_merge(stream, table, detect, at, checkpoint, scope)
            try:
                query_.awaitTermination()
                break
            except StreamingQueryException:
                assert table.last() == 1, "a lost batch leaves the table as it was"
    return table.read().select(
        *DETAILS, "errno", "level", "filename", F.when(F.col("errno") != 421, F.col("detail")).alias("detail"),
        F.when(F.col("errno") != 421, F.col("ctime")).cast("string").alias("ctime"),
    )


_COPIES = """
SELECT package, version, repo, filename, size, mtime FROM fx_packages UNION ALL SELECT package, version, repo, filename, size, mtime FROM fx_duplicates"""


@query("resolve_duplicates", f"""
SELECT package, version, repo, filename, row_number() OVER (PARTITION BY package, version, repo ORDER BY mtime DESC, filename DESC) = 1 AS kept FROM ({_COPIES})""")
def _(fx):
    cols = [*PACKAGE_KEY, "filename", "size", "mtime"]
    copies = fx.packages.select(*cols).unionByName(fx.duplicates.select(*cols))
    kept, rest = changes.resolve_duplicates(stored(copies, "copies"))
    return kept.withColumn("kept", F.lit(True)).unionByName(rest.withColumn("kept", F.lit(False))).select(
        *PACKAGE_KEY, "filename", "kept"
    )


@query("upsert_dependencies", """
SELECT package, version, repo, relationship, CASE WHEN relationship = 'Depends' AND strpos(value, '|') > 0 THEN 'replaced' ELSE value END AS value FROM fx_dependencies""")
def _(fx):
    new = fx.dependencies.filter("relationship = 'Depends' AND instr(value, '|') > 0").withColumn(
        "value", F.lit("replaced")
    )
    return changes.upsert_dependencies(fx.dependencies, new)


@query("register_repos", "SELECT name, CASE WHEN testing = 0 THEN 'seen' ELSE path END AS path FROM fx_repos")
def _(fx):
    known = fx.repos.filter("testing <> 0").select("name", "path")
    return changes.register_repos(known, fx.repos.select("name", F.lit("seen").alias("path")))


@query("touch_repos", f"""
SELECT name, CAST(CASE WHEN name IN (SELECT repo FROM ox_new_packages) THEN {_NOW} ELSE mtime END AS VARCHAR) AS mtime FROM fx_repos""")
def _(fx):
    return changes.touch_repos(fx.repos, changed(fx), now()).select("name", *text_of("mtime"))


@query("missing_repos", "SELECT DISTINCT path FROM fx_repos WHERE path NOT IN (SELECT path FROM fx_repos WHERE testing = 0)")
def _(fx):
    return changes.missing_repos(fx.repos, fx.repos.filter("testing = 0").select("path"))


@query("purge_repos", """
SELECT p.repo, count(*) AS n FROM fx_packages p JOIN fx_repos r ON r.name = p.repo WHERE r.path IN (SELECT path FROM fx_repos WHERE testing = 0) GROUP BY p.repo""")
def _(fx):
    gone = changes.missing_repos(fx.repos, fx.repos.filter("testing = 0").select("path"))
    kept = changes.purge_repos({"packages": fx.packages}, fx.repos, gone)
    return kept["packages"].groupBy("repo").agg(F.count("*").alias("n"))


_GC_TABLES = ("packages", "duplicates", "dependencies", "sodep", "files")
_GC_COUNTS = " UNION ALL ".join([
    *[f"SELECT '{t}' AS tab, r.path, r.testing, count(*) AS n FROM fx_{t} t JOIN fx_repos r ON r.name = t.repo GROUP BY r.path, r.testing" for t in _GC_TABLES],
    "SELECT 'repos', path, testing, count(*) FROM fx_repos GROUP BY path, testing",
])


@query("gc_run", f"""
SELECT step, tab, path, CAST(sum(n) AS BIGINT) AS n FROM ({_GC_COUNTS}) c
JOIN (VALUES ('dry', true), ('removed', true), ('left', false)) s(step, missing) ON s.missing = (c.testing <> 0) GROUP BY step, tab, path""")
def _(fx):
    """A dry run, a run and what is left, over all tables; only stable folders are still there."""
    tables = {}
    for name in (*_GC_TABLES, "repos"):
        held = getattr(fx, name)
        tables[name] = Committed(fx.spark, fresh_folder(fx, f"gc-{name}"), held.schema)
        tables[name].append(held)
        # Relations made from this one are read from its table.
        fx.put(name, tables[name].read())
    there = fx.repos.filter("testing = 0").select("path")
    dry = gc(tables, there, dry_run=True).withColumn("step", F.lit("dry"))
    removed = gc(tables, there).withColumn("step", F.lit("removed"))
    place = fx.repos.select(F.col("name").alias("repo"), "path")
    steps = dry.unionByName(removed)
    for name, table in tables.items():
        rows = table.read() if name == "repos" else table.read().select("repo").join(place, "repo")
        left = rows.groupBy("path").agg(F.count("*").alias("n")).select(F.lit("left").alias("step"), F.lit(name).alias("tab"), "path", "n")
        steps = steps.unionByName(left)
    return steps.select("step", "tab", "path", "n")


# ---- published indexes ---------------------------------------------------

def with_sha(df: DataFrame) -> DataFrame:
    return df.withColumn("sha256", F.sha2("filename", 256))


@query("package_index", """
SELECT p.package, p.version, p.repo, r.path, p.filename, coalesce(d.relations, '') AS relations
FROM fx_packages p JOIN fx_repos r ON r.name = p.repo LEFT JOIN (
  SELECT package, version, repo, string_agg(relationship || '=' || value, ';' ORDER BY relationship) AS relations FROM fx_dependencies GROUP BY package, version, repo) d
ON d.package = p.package AND d.version = p.version AND d.repo = p.repo WHERE p.debtime IS NOT NULL""")
def _(fx):
    rows = index.package_index(fx.packages, fx.repos, fx.dependencies)
    joined = F.array_join(
        F.transform("relations", lambda r: F.concat(r["key"], F.lit("="), r["value"])), ";"
    )
    return rows.select(*PACKAGE_KEY, "path", "filename", joined.alias("relations"))


_STANZA = """
'Package: ' || p.package || chr(10) || 'Version: ' || p.version || chr(10) || CASE WHEN p.section IS NULL THEN '' ELSE 'Section: ' || p.section || chr(10) END
  || 'Architecture: ' || p.architecture || chr(10) || 'Installed-Size: ' || CAST(p.installed_size AS VARCHAR) || chr(10) || 'Maintainer: ' || p.maintainer || chr(10)
  || 'Filename: ' || p.filename || chr(10) || 'Size: ' || CAST(p.size AS VARCHAR) || chr(10) || 'SHA256: ' || sha256(p.filename) || chr(10)
  || coalesce(d.relations, '') || 'Description: ' || p.description || chr(10)"""


@query("render_stanza", f"""
SELECT r.branch, r.component, p.architecture, p.package, p.version, {_STANZA} AS value
FROM fx_packages p JOIN fx_repos r ON r.name = p.repo LEFT JOIN (
  SELECT package, version, repo, string_agg(relationship || ': ' || value || chr(10), '' ORDER BY relationship) AS relations FROM fx_dependencies GROUP BY package, version, repo) d
ON d.package = p.package AND d.version = p.version AND d.repo = p.repo WHERE p.debtime IS NOT NULL""")
def _(fx):
    return index.rendered_index(index.package_index(with_sha(fx.packages), fx.repos, fx.dependencies))


@query("write_package_index", """
SELECT r.branch, r.component, p.architecture, count(*) AS stanzas FROM fx_packages p JOIN fx_repos r ON r.name = p.repo
WHERE p.debtime IS NOT NULL GROUP BY r.branch, r.component, p.architecture""")
def _(fx):
    target = fresh_folder(fx, "index")
    index.write_package_index(
        index.package_index(with_sha(fx.packages), fx.repos, fx.dependencies), target
    )
    lines = fx.spark.read.text(f"{target}/gzip")
    return lines.filter("value LIKE 'Package: %'").groupBy("branch", "component", "architecture").agg(
        F.count("*").alias("stanzas")
    )


@query("index_architectures", "SELECT DISTINCT branch, component, architecture FROM (SELECT branch, component, architecture FROM fx_repos UNION ALL SELECT branch, component, 'all' FROM fx_repos)")
def _(fx):
    return index.index_architectures(fx.repos)


_CONTENTS = """
SELECT t.path AS repo_path, t.target AS architecture, f.path || '/' || f.name AS file,
  string_agg(DISTINCT coalesce(p.section || '/', '') || p.package, ',' ORDER BY coalesce(p.section || '/', '') || p.package) AS packages
FROM (SELECT DISTINCT path, architecture AS target FROM fx_repos WHERE architecture <> 'all') t
JOIN fx_repos r ON r.path = t.path AND r.architecture IN (t.target, 'all') JOIN fx_packages p ON p.repo = r.name AND p.debtime IS NOT NULL
JOIN fx_files f ON f.package = p.package AND f.version = p.version AND f.repo = p.repo AND f.ftype = 'reg'
GROUP BY t.path, t.target, f.path, f.name"""


@query("contents_index", _CONTENTS)
def _(fx):
    return index.contents_index(fx.files, fx.packages, fx.repos)


@query("contents_lines", f"SELECT repo_path, architecture, CASE WHEN length(file) < 55 THEN rpad(file, 55, ' ') ELSE file END || ' ' || packages AS value FROM ({_CONTENTS})")
def _(fx):
    return index.contents_lines(index.contents_index(fx.files, fx.packages, fx.repos))


@query("release_manifest", f"""
SELECT b.branch, 'Origin: og' || chr(10) || 'Label: lb' || chr(10) || 'Suite: ' || b.branch || chr(10) || 'Codename: cn' || chr(10) || 'Description: Branch ' || b.branch || chr(10)
  || 'Date: Wed, 01 Jan 2020 00:00:00 +0000' || chr(10) || 'Valid-Until: Sat, 11 Jan 2020 00:00:00 +0000' || chr(10)
  || 'Architectures: ' || a.archs || chr(10) || 'Components: ' || a.comps || chr(10) || 'SHA256:' || e.lines || chr(10) AS manifest
FROM (SELECT DISTINCT branch FROM fx_repos) b
JOIN (SELECT branch, string_agg(DISTINCT architecture, ' ' ORDER BY architecture) AS archs, string_agg(DISTINCT component, ' ' ORDER BY component) AS comps FROM fx_repos GROUP BY branch) a ON a.branch = b.branch
JOIN (SELECT branch, string_agg(chr(10) || ' ' || sha || ' ' || lpad(CAST(size AS VARCHAR), 16, ' ') || ' ' || name, '' ORDER BY name) AS lines FROM (
  SELECT r.branch, r.component || '/binary-' || p.architecture || '/Packages' AS name, CAST(sum(p.size) AS BIGINT) AS size, sha256(max(p.filename)) AS sha
  FROM fx_packages p JOIN fx_repos r ON r.name = p.repo GROUP BY r.branch, r.component, p.architecture) GROUP BY branch) e ON e.branch = b.branch""")
def _(fx):
    place = fx.repos.select(F.col("name").alias("repo"), "branch", "component")
    name = F.concat("component", F.lit("/binary-"), "architecture", F.lit("/Packages"))
    files = (
        fx.packages.join(place, "repo").groupBy("branch", name.alias("name"))
        .agg(F.sum("size").alias("size"), F.sha2(F.max("filename"), 256).alias("sha256"))
    )
    names = fx.repos.select("branch").distinct()
    defaults = {"codename": "cn", "desc": "Branch %BRANCH%", "label": "lb", "origin": "og", "ttl": 10}
    conf = branches.branch_dimension(names, defaults)
    made = F.make_timestamp(*[F.lit(x) for x in (2020, 1, 1, 0, 0, 0)], F.lit("UTC"))
    return index.release_manifest(conf, fx.repos, fx.repos, files, made)


@query("stale_branches", """
SELECT branch FROM (SELECT branch, CAST(epoch(max(mtime)) AS BIGINT) AS modified FROM fx_repos GROUP BY branch)
WHERE NOT (branch = 'stable')""")
def _(fx):
    modified = catalogue.branch_modified(fx.repos)
    later = F.when(F.col("branch") == "stable", 10).otherwise(-10)
    released = modified.select(
        "branch", (F.col("modified") + later).alias("released"),
        (F.col("modified") + 900000).alias("valid_until"),
    ).filter("branch <> 'explosive'")
    first = modified.agg(F.min("modified").alias("m")).scalar()
    return index.stale_branches(modified.select("branch", F.lit(2).alias("renew_in")), modified, released, first)


_PUBLISHED_FILES = f"""
SELECT branch, name || ending AS name, value FROM (
  SELECT r.branch, r.component || '/binary-' || p.architecture || '/Packages' AS name, string_agg({_STANZA} || chr(10), '' ORDER BY p.package, p.version, {_STANZA}) AS value
  FROM ox_described p JOIN fx_repos r ON r.name = p.repo LEFT JOIN (
    SELECT package, version, repo, string_agg(relationship || ': ' || value || chr(10), '' ORDER BY relationship) AS relations FROM fx_dependencies GROUP BY package, version, repo) d
  ON d.package = p.package AND d.version = p.version AND d.repo = p.repo WHERE p.debtime IS NOT NULL GROUP BY r.branch, r.component, p.architecture
  UNION ALL SELECT split_part(repo_path, '/', 1), split_part(repo_path, '/', 2) || '/Contents-' || architecture, string_agg(line, '' ORDER BY line) FROM (
    SELECT repo_path, architecture, CASE WHEN length(file) < 55 THEN rpad(file, 55, ' ') ELSE file END || ' ' || packages || chr(10) AS line FROM ({_CONTENTS}))
  GROUP BY repo_path, architecture) CROSS JOIN (SELECT unnest(['', '.gz']) AS ending)"""


@query("release_run", _PUBLISHED_FILES, ox_described="""
SELECT * REPLACE (CASE WHEN r.branch = 'stable' THEN 'old' ELSE p.description END AS description) FROM fx_packages p JOIN (SELECT name, branch FROM fx_repos) r ON r.name = p.repo""")
def _(fx):
    """Whole texts of published files after two runs; the second leaves a fresh branch alone."""
    names = fx.repos.select("branch").distinct()
    conf = branches.branch_dimension(names, {"codename": "cn", "desc": "Branch %BRANCH%", "label": "lb", "origin": "og", "ttl": 10, "renew_in": 2})
    target = fresh_folder(fx, "published")
    fx.keep("dependencies", "files")
    tables = {"repos": fx.repos, "packages": with_sha(fx.packages), "dependencies": fx.dependencies, "files": fx.files}
    at = F.make_timestamp(*[F.lit(x) for x in (2020, 1, 1, 0, 0, 0)], F.lit("UTC"))
    none = fx.spark.createDataFrame([], "branch string, released bigint, valid_until bigint")
    publish(fx.spark, tables | {"packages": tables["packages"].withColumn("description", F.lit("old"))}, conf, none, at, target)
    fresh = names.filter("branch = 'stable'").select("branch", F.unix_seconds(at).alias("released"), (F.unix_seconds(at) + 864000).alias("valid_until"))
    publish(fx.spark, tables, conf, fresh, at, target)
    texts = fx.spark.read.text(target, wholetext=True, recursiveFileLookup=True)
    place = F.split(F.col("_metadata.file_path"), f"{target.rsplit('/', 1)[1]}/")[1]
    return texts.select(
        F.split(place, "/", 2)[0].alias("branch"), F.split(place, "/", 2)[1].alias("name"), "value"
    ).filter("name <> 'Release' AND value <> ''")


# ---- copies of remote tables ---------------------------------------------

@query("sync_run", """
SELECT r.branch AS source, 'kept' AS origin, p.* FROM fx_packages p JOIN (SELECT name, branch FROM fx_repos) r ON r.name = p.repo WHERE r.branch <> 'stable' OR p.size % 50 <> 0""".replace(
    "p.*", "p.package, p.version, p.repo, p.size, p.section, CAST(p.mtime AS VARCHAR) AS mtime"))
def _(fx):
    """Two runs over a source whose etag stays, one that changed and one that is new in the second."""
    place = fx.repos.select(F.col("name").alias("repo"), "branch")
    rows = stored(fx.packages.join(place, "repo"), "remote-packages")
    keys, folder = tuple(PACKAGE_KEY), fresh_folder(fx, "synced")

    def remote(branch: str, some: str) -> Source:
        own = rows.filter((F.col("branch") == branch) & F.expr(some)).drop("branch")
        return Source(own, keys, {"origin": F.lit("kept")}, buckets=8)

    for etag, some, found in (("1", "size % 50 <> 0", ("stable", "testing")), ("2", "true", ("stable", "testing", "explosive"))):
        listing = fx.spark.createDataFrame([(b, "1" if b == "stable" else etag) for b in found], "name string, etag string")
        copied = sync(fx.spark, {b: remote(b, some) for b in found}, listing, folder, now())
        assert set(copied) == set(found) - ({"stable"} if etag == "2" else set())
    held = [
        Committed(fx.spark, f"{folder}/{b}", remote(b, "true").full().schema, keys, 8).read().withColumn("source", F.lit(b))
        for b in ("stable", "testing", "explosive")
    ]
    return held[0].unionByName(held[1]).unionByName(held[2]).select(
        "source", "origin", *PACKAGE_KEY, "size", "section", *text_of("mtime")
    )


# ---- stanza operators ----------------------------------------------------

@query("parse_relations", f"""
SELECT raw, CAST(g AS INTEGER) AS grp, CAST(a AS INTEGER) AS alt, coalesce(nullif(regexp_extract(atom, {quoted(RELATION)}, 1), ''), atom) AS name,
  nullif(regexp_extract(atom, {quoted(RELATION)}, 2), '') AS archqual, nullif(regexp_extract(atom, {quoted(RELATION)}, 3), '') AS relop,
  nullif(regexp_extract(atom, {quoted(RELATION)}, 4), '') AS version,
  coalesce(regexp_replace(trim(nullif(regexp_extract(atom, {quoted(RELATION)}, 5), '')), '\\s+', ' ', 'g'), '') AS archs,
  coalesce(lower(nullif(regexp_extract(atom, {quoted(RELATION)}, 6), '')), '') AS profiles
FROM (SELECT raw, g, unnest(regexp_split_to_array(part, '\\s*\\|\\s*')) AS atom, unnest(range(1, len(regexp_split_to_array(part, '\\s*\\|\\s*')) + 1)) AS a
  FROM (SELECT raw, unnest(regexp_split_to_array(trim(raw), '\\s*,\\s*')) AS part, unnest(range(1, len(regexp_split_to_array(trim(raw), '\\s*,\\s*')) + 1)) AS g FROM fx_relations))""")
def _(fx):
    # Out of a generator, so that the filters Spark derives from the next one do not parse the text again.
    parsed = fx.relations.withColumn("r", F.explode(F.array(relations.parse_relations(F.col("raw")))))
    alts = parsed.select("raw", F.posexplode("r").alias("g", "alts"))
    one = alts.select("raw", "g", F.posexplode("alts").alias("a", "x"))

    def terms(col: Column) -> Column:
        return F.array_join(
            F.transform(col, lambda t: F.concat(F.when(t["enabled"], "").otherwise("!"), t["label"])), " "
        )

    groups = F.transform(F.col("x.restrictions"), lambda g: F.concat(F.lit("<"), terms(g), F.lit(">")))
    return one.select(
        "raw", (F.col("g") + 1).alias("grp"), (F.col("a") + 1).alias("alt"), "x.name", "x.archqual",
        "x.relop", "x.version", F.coalesce(terms(F.col("x.arch")), F.lit("")).alias("archs"),
        F.coalesce(F.array_join(groups, " "), F.lit("")).alias("profiles"),
    )


@query("format_relations", """
SELECT raw, regexp_replace(replace(replace(regexp_replace(raw, '\\s*,\\s*', ', ', 'g'), ':amd64', ''), 'Cross', 'cross'), '\\s+$', '') AS value FROM fx_relations""")
def _(fx):
    return fx.relations.select(
        "raw", relations.format_relations(relations.parse_relations(F.col("raw"))).alias("value")
    )


@query("relation_fields", """
SELECT package, version, repo, 2 AS depends, 'libc' AS first_name, package || '-data' AS second_name, 0 AS conflicts FROM fx_packages""")
def _(fx):
    read = stanza_source.with_fields(fx.stanza_text, "text")
    out = stanzas.relation_fields(read, "binary")
    return out.select(
        *PACKAGE_KEY, F.size("depends").alias("depends"),
        F.col("depends")[0][0]["name"].alias("first_name"), F.col("depends")[1][0]["name"].alias("second_name"),
        F.size("conflicts").alias("conflicts"),
    )


@query("merge_fields", """
SELECT package, version, repo, list_aggregate(list_sort(list_distinct(string_split(section || ', util, ' || architecture, ', '))), 'string_agg', ', ') AS one_line,
  chr(10) || ' ' || description || chr(10) || ' b' || CASE WHEN description || 'x' = package THEN '' ELSE chr(10) || ' ' || package END AS many_lines
FROM fx_packages WHERE section IS NOT NULL""")
def _(fx):
    one = stanzas.merge_fields(F.concat("section", F.lit(", util")), F.col("architecture"))
    many = stanzas.merge_fields(
        F.concat(F.lit("\n "), "description", F.lit("\n b")), F.concat(F.lit("\n b\n "), "package")
    )
    return fx.packages.filter("section IS NOT NULL").select(
        *PACKAGE_KEY, one.alias("one_line"), many.alias("many_lines")
    )


_CHECKSUMS = """
SELECT package, version, repo, 'sha256' AS field, 1 AS nr, substring(filename, 1, 8) AS digest, CAST(size AS VARCHAR) AS size, package || '.tar' AS name FROM fx_packages
UNION ALL SELECT package, version, repo, 'sha256', 2, 'abc', CAST(installed_size AS VARCHAR), package || '.dsc' FROM fx_packages"""


def checksum_rows(fx: Fixtures) -> DataFrame:
    df = fx.checksum_text.withColumn("fields", F.create_map(F.lit("sha256"), "value"))
    return stanzas.explode_checksums(df, "release", PACKAGE_KEY)


@query("explode_checksums", _CHECKSUMS)
def _(fx):
    return checksum_rows(fx).drop("section", "priority", "date")


@query("format_checksums", f"""
SELECT package, version, repo, field, string_agg(chr(10) || ' ' || digest || ' ' || lpad(size, 16, ' ') || ' ' || name, '' ORDER BY nr) AS value
FROM ({_CHECKSUMS}) GROUP BY package, version, repo, field""")
def _(fx):
    return stanzas.format_checksums(checksum_rows(fx), "release", PACKAGE_KEY, width=16)


@query("upload_pool_path", """
SELECT package, version, repo, 'pool/' || CASE WHEN section = 'lib' THEN 'opt' ELSE 'main' END || '/' || CASE WHEN package LIKE 'lib%' THEN substring(package, 1, 4) ELSE substring(package, 1, 1) END || '/' || package AS pool_path FROM fx_packages""")
def _(fx):
    section = F.when(F.col("section") == "lib", "opt/lib").otherwise("util")
    files = F.concat(F.lit("\n d1 10 "), section, F.lit(" optional a.tar\n d2 11 other/x optional b.tar"))
    df = fx.packages.withColumn(
        "fields", F.create_map(F.lit("source"), F.col("package"), F.lit("files"), files)
    )
    return df.select(*PACKAGE_KEY, stanzas.upload_pool_path(df).alias("pool_path"))


@query("removals", """
SELECT package, version, repo, '2021-02-03 02:04:05' AS date, CAST(size AS INTEGER) AS bug, package AS source, 2 AS n_binaries, 'amd64,arm64' AS architectures FROM fx_packages""")
def _(fx):
    def line(key: str, value: Column) -> list[Column]:
        return [F.lit(key), value]

    fields = F.create_map(
        *line("date", F.lit("Wed, 03 Feb 2021 04:04:05 +0200")),
        *line("bug", F.concat(F.col("size").cast("string"), F.lit(",7"))),
        *line("sources", F.concat(F.lit("\n "), "package", F.lit("_"), "version")),
        *line("binaries", F.concat(
            F.lit("\n "), "package", F.lit("_"), "version", F.lit(" [amd64, arm64]\n x_1 [all]"))),
    )
    out = stanzas.removals(fx.packages.withColumn("fields", fields), PACKAGE_KEY)
    return out.select(
        *PACKAGE_KEY,
        F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("date").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.col("bug")[0].alias("bug"), F.col("sources")[0]["source"].alias("source"),
        F.size("binaries").alias("n_binaries"),
        F.array_join(F.col("binaries")[0]["architectures"], ",").alias("architectures"),
    )


@query("invalid_values", r"""
SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN 'ends with a newline' WHEN contains(text, chr(10) || chr(10)) THEN 'has a blank line' ELSE 'continuation without leading space' END AS reason
FROM documents WHERE ends_with(text, chr(10)) OR contains(text, chr(10) || chr(10)) OR regexp_matches(text, '\n[^ \t\n\f\r\v]')""")
def _(fx):
    rows = fx.documents.select(
        "doc_id", F.array(F.struct(F.lit("Text").alias("key"), F.col("text").alias("value"))).alias("entries")
    )
    return stanzas.invalid_values(rows, ["doc_id"]).select("doc_id", "reason")


@query("stanza_equal", "SELECT package, version, repo, section IS NULL OR section <> 'lib' AS same FROM fx_packages")
def _(fx):
    left = F.create_map(F.lit("a"), F.col("package"), F.lit("b"), F.col("version"))
    right = F.create_map(
        F.lit("b"), F.col("version"), F.lit("a"),
        F.when(F.col("section") == "lib", "other").otherwise(F.col("package")),
    )
    return fx.packages.select(*PACKAGE_KEY, stanzas.stanza_equal(left, right).alias("same"))
