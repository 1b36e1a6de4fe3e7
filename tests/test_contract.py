"""Registered queries against their DuckDB SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
# Rows that have results at the smallest scale, where some detectors find nothing.
NOT_EMPTY = (
    "version_key", "latest_packages", "dependency_atoms", "compatible_repos_soname", "i102", "i302",
    "i302_changed", "i411", "i421", "i421_indexed", "i431", "merge_issues", "issue_stats", "classify_changes", "contents_index",
    "stream_changes", "stream_snapshot_merge", "committed_change_events", "views_refreshed", "version_key_long", "read_stanzas_ranges",
    "stats_as_of", "release_run", "sync_run", "gc_run",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def test_every_query_of_the_library_has_a_check():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(contract.library_queries()) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).columns == ["package", "version", "repo", "architecture", "filename", "size", "vk"]


@pytest.mark.parametrize("name", sorted(contract.library_queries()))
def test_matches_duckdb(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert got == want and (got or name not in NOT_EMPTY)
