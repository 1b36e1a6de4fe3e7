"""Table schemas of a package repository catalogue."""

from __future__ import annotations

from pyspark.sql.types import StructType

_PACKAGE = (
    "package string, version string, repo string, architecture string, filename string, "
    "size bigint, sha256 string, mtime bigint, debtime bigint, section string, "
    "installed_size bigint, maintainer string, description string, vk string"
)

DDL = {
    "repos": "name string, realname string, path string, testing int, branch string, "
    "component string, architecture string, mtime timestamp",
    "packages": _PACKAGE,
    "duplicates": _PACKAGE,
    "dependencies": "package string, version string, repo string, relationship string, value string",
    "sodep": "package string, version string, repo string, depends int, name string, ver string",
    "files": "package string, version string, repo string, path string, name string, size bigint, "
    "ftype string, perm int, uid bigint, gid bigint, uname string, gname string",
    "issues": "package string, version string, repo string, errno int, level int, filename string, "
    "ctime timestamp, mtime timestamp, atime timestamp, detail string",
    "issue_stats": "repo string, errno int, cnt bigint, total bigint, updated timestamp",
    "trees": "tid int, name string, category string, url string, mainbranch string",
    "tree_branches": "name string, tree string, branch string, priority int",
    "sources": "name string, tree string, category string, section string, pkg_section string, "
    "directory string, description string",
    "source_dups": "package string, tree string, category string, section string, directory string",
    "source_versions": "package string, branch string, architecture string, version string, "
    "release string, epoch string, commit_time bigint, committer string, githash string",
    "source_deps": "package string, dependency string, relop string, version string, "
    "architecture string, relationship string",
    "marks": "tree int, name string, rid int, uuid string, githash string",
    "package_rel": "tree int, rid int, package string, version string, release string, "
    "epoch string, message string",
    "basherr": "tree int, rid int, filename string, category string, section string, "
    "directory string, package string, err string",
    "upstream": "package string, type string, version string, time bigint, url string, tarball string",
    "upstream_links": "package string, projectid int",
    "upstream_projects": "id int, name string, latest_version string, updated_on bigint",
    "source_control": "name string, etag string, updated timestamp",
    "change_events": "comp string, pkg string, arch string, method string, from_ver string, to_ver string",
}

ISSUE_KEY = ["package", "version", "repo", "errno", "filename"]
FINDING_COLUMNS = ["package", "version", "repo", "errno", "level", "filename", "detail"]
PACKAGE_KEY = ["package", "version", "repo"]


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])
