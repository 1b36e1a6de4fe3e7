"""The registered queries against their DuckDB statements, and their contract columns."""

import os

import duckdb
import pytest

from poolscope.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

COLUMNS = {
    "op1_source_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_quality": ["doc_id", "held_out", "score", "predicted"],
    "op9_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_token_file": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall()) and got


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name] and not df.isEmpty()
