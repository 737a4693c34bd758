"""Every query against its SQL, on the smallest tables where they are at hand."""

from __future__ import annotations

import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
#: Queries without SQL, each with the test that compares it with brute force, a library or another query.
BRUTE_FORCE = {
    "assigned_files": "test_catalog.test_partial_titles_equal_brute_force", "p5_found": "test_multivalue_nested.test_titles", "p1_found": "llm.test_canonical.test_mapping",
    "p1_unmatched": "llm.test_schemas_llm.test_reports_agree_with_the_rows_they_count", "p8_ids": "llm.test_tokens.test_against_library",
    "p8_lengths": "llm.test_schemas_llm.test_reports_agree_with_the_rows_they_count", "p9_found": "llm.test_leakage.test_leaks_found_and_quotations_not",
    "p9_items": "llm.test_schemas_llm.test_reports_agree_with_the_rows_they_count", "p10_found": "llm.test_reading.test_held_out_accuracy_and_edge_cases",
}
KEYS = {"rom_id", "file_id", "row_key", "pos", "record_id", "token", "doc_id", "item_id", "level", "rows", "documents", "tokens"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    statement = entry.oracle_sql().get(name)
    if statement is None:
        # What SQL cannot state is compared with brute force elsewhere; here it must give well-formed rows.
        assert name in BRUTE_FORCE and got and None not in {v for row in got for c, v in zip(columns, row) if c in KEYS}
        return
    result = sql.execute(statement)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = ordered([tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall()])
    assert got == want


def test_entry_is_lazy_and_filled(spark):
    assert entry.entry(spark).count() > 0


def test_queries_name_their_columns():
    assert set(entry.oracle_sql()) <= set(entry.queries())
