"""Package-repository relations derived from the supplied tables.

Every text is SQL that both Spark and DuckDB accept, so a query and its check
read the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from poolscope.plans.storage import stored
from poolscope.schemas import PACKAGE_KEY

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents",
)

FIXTURES = {
    "fx_repos": """
SELECT n_name AS name, architecture AS realname, branch || '/' || component AS path, testing,
  branch, component, architecture, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE t END AS mtime
FROM (SELECT n_nationkey, n_name,
    CASE n_nationkey % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'amd64' WHEN 2 THEN 'arm64' ELSE 'riscv64' END AS architecture,
    n_regionkey % 3 AS testing,
    CASE n_regionkey % 3 WHEN 0 THEN 'stable' WHEN 1 THEN 'testing' ELSE 'explosive' END AS branch,
    CASE WHEN n_nationkey % 5 = 0 THEN 'opt' ELSE 'main' END AS component,
    (SELECT min(l_shipdate) FROM lineitem) AS t
  FROM nation) n""",
    "fx_lines": """
SELECT CASE WHEN l_partkey % 7 = 0 THEN 'lib' ELSE 'pkg' END || CAST(l_partkey AS STRING) AS package,
  CASE WHEN l_linenumber = 7 THEN '1:' ELSE '' END || CAST(CAST(l_quantity AS INT) AS STRING)
    || '.' || CAST(l_linenumber AS STRING)
    || CASE l_returnflag WHEN 'R' THEN '~rc1' WHEN 'A' THEN '+git' ELSE '' END
    || CASE WHEN round(l_discount*100) = 0 THEN ''
       ELSE '-' || CAST(CAST(round(l_discount*100) AS INT) AS STRING) END AS version,
  n_name AS repo, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax, l_shipdate,
  l_partkey, l_suppkey
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""",
    "fx_packages": """
SELECT package, version, repo, architecture,
  'pool/' || branch || '/' || component || '/'
    || substring(package, 1, CASE WHEN package LIKE 'lib%' THEN 4 ELSE 1 END)
    || '/' || package || '_' || version || '_' || architecture || '.deb' AS filename,
  q.size, q.mtime, q.debtime, CASE section_rank WHEN 1 THEN 'lib' WHEN 2 THEN 'util' ELSE NULL END AS section, installed_size,
  CASE maintainer_rank WHEN 0 THEN 'Null Packager <null@example.org>' WHEN 1 THEN 'Supplier <s@example.org>' ELSE 'nomail' END AS maintainer,
  'about ' || CAST(partkey AS STRING) AS description
FROM (
  SELECT package, version, repo, CAST(floor(min(l_extendedprice)) AS BIGINT) AS size, max(l_shipdate) AS mtime,
    CASE WHEN max(l_tax) = 0 THEN NULL ELSE max(l_shipdate) END AS debtime,
    min(CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 1 END) AS section_rank, max(l_orderkey) AS installed_size,
    min(CASE l_suppkey % 10 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) AS maintainer_rank, min(l_partkey) AS partkey
  FROM fx_lines GROUP BY package, version, repo) q
JOIN fx_repos ON name = repo""",
    "fx_duplicates": """
SELECT package, version, repo, filename || '.dup' AS filename, size, mtime
FROM fx_packages WHERE version LIKE '1:%' AND size % 5 = 0""",
    "fx_depends": """
SELECT DISTINCT a.package, a.version, a.repo,
  CASE WHEN a.l_linenumber % 3 = 0 THEN 'Recommends' WHEN a.l_linenumber % 5 = 0 THEN 'Conflicts' ELSE 'Depends' END AS relationship,
  b.package || CASE WHEN b.l_linenumber % 7 = 0 THEN ':amd64' ELSE '' END
    || CASE WHEN a.l_linenumber % 2 = 0 THEN ' (>= ' || b.version || ')' ELSE '' END AS dep
FROM fx_lines a JOIN fx_lines b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.package <> b.package""",
    "fx_dependencies": """
SELECT package, version, repo, relationship, min(dep)
  || CASE WHEN max(dep) = min(dep) THEN '' WHEN length(min(dep)) % 2 = 0 THEN ', ' || max(dep) ELSE ' | ' || max(dep) END
  || CASE WHEN length(max(dep)) % 9 = 0 THEN ', ?' ELSE '' END AS value
FROM fx_depends GROUP BY package, version, repo, relationship""",
    "fx_files": """
SELECT DISTINCT package, version, repo,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'usr/bin' WHEN '2-HIGH' THEN 'usr/lib'
    WHEN '3-MEDIUM' THEN 'usr/local' WHEN '4-NOT SPECIFIED' THEN 'srvdata' ELSE '' END AS path,
  CASE WHEN o_custkey % 40 = 0 THEN 'README' WHEN o_custkey % 41 = 0 THEN '.hidden'
    WHEN o_custkey % 43 = 0 THEN '__init__.py' ELSE 'f' || CAST(o_custkey AS STRING) END AS name,
  CAST(l_quantity AS BIGINT) % 5 AS size,
  CASE WHEN l_linenumber = 6 THEN 'dir' ELSE 'reg' END AS ftype,
  CASE WHEN l_linenumber = 6 THEN CASE WHEN l_suppkey % 2 = 0 THEN 438 ELSE 493 END
    WHEN l_linenumber % 2 = 0 THEN 493 ELSE 420 END AS perm,
  o_custkey % 1100 AS uid, o_custkey % 1050 AS gid, 'u' || CAST(o_custkey % 9 AS STRING) AS uname,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'staff' END AS gname
FROM fx_lines JOIN orders ON o_orderkey = l_orderkey""",
    "fx_sodep": """
SELECT DISTINCT package, version, repo, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END AS depends,
  'lib' || CAST(l_partkey - l_partkey % 8 AS STRING) || '.so' AS name,
  CASE WHEN l_quantity = 1 THEN '' ELSE '.' || CAST(CAST(l_quantity AS INT) % 3 AS STRING)
    || CASE WHEN CAST(l_quantity AS INT) % 4 = 0 THEN '.0' ELSE '' END END AS ver
FROM fx_lines""",
    "fx_sources": """
SELECT CASE WHEN p_partkey % 50 = 0 THEN 'Src_' WHEN p_partkey % 7 = 0 THEN 'lib' ELSE 'pkg' END || CAST(p_partkey AS STRING) AS name,
  CASE WHEN p_partkey % 3 = 0 THEN 'core-tree' ELSE 'app-tree' END AS tree,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE lower(p_type) END AS category, lower(p_brand) AS section,
  CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 1 THEN 'two words' ELSE 'util' END AS pkg_section,
  'd' || CAST(p_partkey AS STRING) AS directory,
  CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN 'PKG' || CAST(p_partkey AS STRING) ELSE p_name END AS description
FROM part""",
    "fx_trees": """
SELECT DISTINCT CASE WHEN tree = 'core-tree' THEN 1 ELSE 2 END AS tid, tree AS name,
  CASE WHEN tree = 'core-tree' THEN 'base' ELSE 'extra' END AS category, 'stable' AS mainbranch
FROM fx_sources""",
    "fx_tree_branches": """
SELECT tree || '/' || branch AS name, tree, branch, priority FROM (
  SELECT DISTINCT tree, 'stable' AS branch, 0 AS priority FROM fx_sources
  UNION ALL SELECT DISTINCT tree, 'testing', 1 FROM fx_sources
  UNION ALL SELECT DISTINCT tree, 'explosive', 2 FROM fx_sources) t""",
    "fx_source_versions": """
SELECT name AS package, branch, 'any' AS architecture, CAST(length(directory) * 7 AS STRING) || '.2' AS version,
  CASE WHEN length(section) = 8 THEN '0' ELSE '3' END AS release,
  CASE WHEN pkg_section IS NULL THEN '1' WHEN pkg_section = 'two words' THEN 'x' ELSE '' END AS epoch,
  length(name) * 1000 AS commit_time, 'dev' || CAST(length(section) AS STRING) || '@example.org' AS committer,
  'g' || directory AS githash
FROM (SELECT *, 'stable' AS branch FROM fx_sources
  UNION ALL SELECT *, 'testing' AS branch FROM fx_sources) s""",
    "fx_source_dups": """
SELECT name AS package, CASE WHEN length(directory) % 2 = 0 THEN tree ELSE 'other-tree' END AS tree,
  coalesce(category, '') AS category, section, 'old-' || directory AS directory
FROM fx_sources WHERE pkg_section IS NULL
UNION ALL
SELECT name AS package, tree, coalesce(category, '') AS category, section, directory
FROM fx_sources WHERE pkg_section IS NULL""",
    "fx_source_deps": """
SELECT DISTINCT package, dependency, relop, version, 'any' AS architecture, relationship FROM (
  SELECT CASE WHEN p_partkey % 7 = 0 THEN 'lib' ELSE 'pkg' END || CAST(p_partkey AS STRING) AS package,
    CASE WHEN d % 7 = 0 THEN 'lib' ELSE 'pkg' END || CAST(d AS STRING) AS dependency,
    CASE WHEN p_size % 3 = 0 THEN '==' WHEN p_size % 3 = 1 THEN '>=' ELSE NULL END AS relop,
    CASE WHEN p_size % 3 = 2 THEN NULL WHEN p_size % 3 = 1 THEN '14' ELSE '28.2-3' END AS version,
    'PKGDEP' AS relationship
  FROM (
    SELECT p_partkey, p_size, CAST(floor(p_partkey / 3) AS BIGINT) AS d FROM part
    UNION ALL SELECT p_partkey, p_size, p_partkey - p_partkey % 8 AS d FROM part) q
  UNION ALL
  SELECT a.package, b.package, CASE a.l_linenumber WHEN 2 THEN '>=' WHEN 4 THEN '==' WHEN 5 THEN '<<' ELSE NULL END,
    CASE a.l_linenumber WHEN 2 THEN '28' WHEN 4 THEN '35.2-3' WHEN 5 THEN '30' ELSE NULL END, 'BUILDDEP'
  FROM fx_lines a JOIN fx_lines b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1) u""",
    "fx_issues_prev": """
SELECT package, version, repo, 302 AS errno, CASE WHEN size % 2 = 0 THEN 0 ELSE 1 END AS level, filename,
  mtime AS ctime, mtime, mtime AS atime, CASE WHEN size % 4 = 0 THEN NULL ELSE '{"size":' || CAST(size AS STRING) || '}' END AS detail
FROM fx_packages WHERE size % 3 = 0 AND mtime < (SELECT min(l_shipdate) + INTERVAL '900' DAY FROM lineitem)
UNION ALL
SELECT package, version, repo, 431, 0, name || ver, t, t, t,
  '{"repo":"' || repo || '","package":"' || package || '","version":"' || version || '","sover_provide":"' || ver || '"}'
FROM (SELECT *, (SELECT min(l_shipdate) + INTERVAL '300' DAY FROM lineitem) AS t FROM fx_sodep WHERE depends = 1 AND ver <> '') q
UNION ALL
SELECT DISTINCT package, CASE WHEN epoch <> '' THEN version WHEN release = '0' THEN version ELSE version || '-' || release END,
  tree || '/' || branch, 103, 0, githash, t, t, t, CAST(NULL AS STRING)
FROM (SELECT *, (SELECT min(l_shipdate) + INTERVAL '200' DAY FROM lineitem) AS t FROM fx_source_versions) r JOIN fx_sources s ON s.name = package""",
    "fx_listing": """
SELECT CASE WHEN size % 17 = 0 THEN filename || '.new' ELSE filename END AS filename,
  CASE WHEN size % 13 = 0 THEN size + 1 ELSE size END AS size,
  CASE WHEN size % 19 = 0 THEN mtime + INTERVAL '1' DAY ELSE mtime END AS mtime
FROM fx_packages WHERE size % 11 <> 0""",
    "fx_change_arrivals": """
SELECT 'u' || CAST(user_id AS STRING) AS package, event_type AS repo, event_id,
  CAST(event_id % 9 AS STRING) || '.' || CAST(user_id % 5 AS STRING) AS version,
  'stable' AS branch, 'main' AS component, 'amd64' AS architecture
FROM events""",
    "fx_version_pairs": """
SELECT DISTINCT a.version AS left_version, b.version AS right_version,
  CASE a.l_linenumber WHEN 1 THEN '<<' WHEN 2 THEN '<=' WHEN 3 THEN '=' WHEN 4 THEN '>=' WHEN 5 THEN '>>' WHEN 6 THEN '==' ELSE NULL END AS op
FROM fx_lines a JOIN fx_lines b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""",
    "fx_marks": """
SELECT tid AS tree, branch || '-' || githash AS name,
  CAST(substring(githash, 3, 20) AS BIGINT) * 10 + length(branch) AS rid, githash, package, version, release, epoch, branch, t.name AS tree_name
FROM fx_source_versions v JOIN fx_sources s ON s.name = v.package JOIN fx_trees t ON t.name = s.tree""",
    "fx_package_rel": """
SELECT tree, rid, package, version, release, CASE WHEN rid % 3 = 0 THEN NULL ELSE epoch END AS epoch FROM fx_marks""",
    "fx_basherr": """
SELECT m.tree, rid, section || '/' || directory || '/defines' AS filename, category, section, directory,
  CASE WHEN rid % 2 = 0 THEN package ELSE NULL END AS package, 'line ' || CAST(rid % 13 AS STRING) || ': error' AS err
FROM fx_marks m JOIN fx_sources s ON s.name = package""",
    "fx_upstream": """
SELECT name AS package, 'git' AS type, CASE WHEN length(directory) % 2 = 0 THEN NULL ELSE section END AS version,
  length(directory) * 10 AS time, CASE WHEN pkg_section = 'util' THEN 'https://example.org/' || name ELSE NULL END AS url,
  directory || '.tar' AS tarball
FROM fx_sources WHERE category IS NOT NULL""",
    "fx_upstream_links": """
SELECT name AS package, CAST(substring(directory, 2, 20) AS BIGINT) AS projectid
FROM fx_sources WHERE tree = 'core-tree'""",
    "fx_upstream_projects": """
SELECT p_partkey AS id, p_name AS name, CAST(p_size AS STRING) || '.1' AS latest_version, p_size * 100 AS updated_on
FROM part WHERE p_size > 5""",
    "fx_entries": """
SELECT package, version, repo, './usr/lib/lib' || k || '.so' AS path, 0 AS size, 40960 AS type, 511 AS perm, FALSE AS is_dyn,
  '' AS soname, CAST(NULL AS STRING) AS needs FROM (SELECT *, CAST(l_partkey % 97 AS STRING) AS k FROM fx_lines) a
UNION ALL
SELECT package, version, repo, CASE WHEN l_linenumber % 3 = 0 THEN './usr/libexec/./lib' ELSE './lib//lib' END || k || '.so.1.2', 10, 32768, 493, TRUE,
  'lib' || k || '.so.1', 'libc.so.6,lib' || k || '.so,libz.so.' || CAST(l_linenumber AS STRING)
FROM (SELECT *, CAST(l_partkey % 97 AS STRING) AS k FROM fx_lines) b
UNION ALL
SELECT package, version, repo, './usr/bin/../sbin/tool' || k, 20, CASE WHEN l_linenumber = 1 THEN 4096 WHEN l_linenumber = 2 THEN 16384 WHEN l_linenumber = 3 THEN 7 ELSE 32768 END,
  493, l_linenumber > 3, '', 'lib' || k || '.so.1,libm.so.6'
FROM (SELECT *, CAST(l_partkey % 97 AS STRING) AS k FROM fx_lines) c""",
    "fx_stanza_text": """
SELECT package, version, repo, '# made from a package row' || chr(10) || 'Package: ' || package || chr(10) || 'VERSION:' || version
  || chr(10) || 'Architecture: ' || architecture || '  ' || chr(10)
  || CASE WHEN section IS NULL THEN '' ELSE 'Section: ' || section || chr(10) END
  || 'Installed-Size: ' || CAST(installed_size AS STRING) || chr(10) || 'junk line' || chr(10)
  || 'Maintainer: ' || maintainer || chr(10) || 'Depends: libc (>= 2), ' || package || '-data' || chr(10)
  || 'Description: ' || description || chr(10) || ' more text' || chr(10) || ' .' || chr(10) || ' end' AS text
FROM fx_packages""",
    "fx_checksum_text": """
SELECT package, version, repo, chr(10) || ' ' || substring(filename, 1, 8) || ' ' || CAST(size AS STRING) || ' ' || package || '.tar'
  || chr(10) || ' abc  ' || CAST(installed_size AS STRING) || ' ' || package || '.dsc' AS value
FROM fx_packages""",
    "fx_relations": """
SELECT DISTINCT dep || CASE length(dep) % 4 WHEN 0 THEN ' [amd64 !arm64]' WHEN 1 THEN ' <!nocheck Cross> <stage1>' ELSE '' END
  || CASE WHEN length(dep) % 3 = 0 THEN ' | other-' || dep ELSE ',  ' || dep END || CASE WHEN length(dep) % 5 = 0 THEN ' , x' ELSE '' END AS raw
FROM fx_depends""",
}


def required(names: list[str], texts: dict[str, str]) -> list[str]:
    """The named relations and what they read, in defining order."""
    needed: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in needed and name in texts:
            needed.add(name)
            todo += re.findall(r"\b(?:fx|ox)_\w+", texts[name])
    return [n for n in texts if n in needed]


class Fixtures:
    """Derived relations of one data directory as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        fixture = "fx_" + name
        if fixture not in FIXTURES:
            if name not in BASE_TABLES:
                raise AttributeError(name)
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return self._tables[name]
        self._views(required([fixture], FIXTURES))
        return self._tables[fixture]

    def _views(self, names: list[str], *texts: str) -> None:
        """Make the named relations, and views of the tables that they and ``texts`` read."""
        for text in [*(FIXTURES[n] for n in names if n not in self._tables), *texts]:
            for base in BASE_TABLES:
                if re.search(rf"\b{base}\b", text):
                    self._base(base).createOrReplaceTempView(base)
        for name in names:
            if name not in self._tables:
                self._tables[name] = self.spark.sql(FIXTURES[name])
                self._tables[name].createOrReplaceTempView(name)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = build()
        return self._tables[name]

    def keep(self, *names: str) -> None:
        """Write relations once; those derived from them afterwards read what was written."""
        for name in names:
            self.once("kept " + name, lambda: self.put(name, stored(getattr(self, name), name)))

    def together(self, *names: str) -> None:
        """Deal relations of distinct rows by package before the copies go, as joins on the package key want them."""
        for name in names:
            text, distinct = re.subn(r"\A\s*SELECT DISTINCT (\w\.)?package, (\w\.)?version, (\w\.)?repo,", r"SELECT \1package, \2version, \3repo,", FIXTURES["fx_" + name])
            assert distinct, f"{name} has no distinct rows by package"
            if "fx_" + name not in self._tables:
                self._views([n for n in required(["fx_" + name], FIXTURES) if n != "fx_" + name], text)
                self.put(name, self.spark.sql(text).repartition(*PACKAGE_KEY).distinct())

    def put(self, name: str, written: DataFrame) -> DataFrame:
        """Let ``written``, the rows of a relation, stand for it from now on."""
        self._tables["fx_" + name] = written
        written.createOrReplaceTempView("fx_" + name)
        return written

    def _base(self, name: str) -> DataFrame:
        return self._tables[name] if name in self._tables else getattr(self, name)
