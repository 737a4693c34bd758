"""Columns and types of the found queries of the corpus problems."""

from __future__ import annotations

import os

import pytest

from cartulary.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")

SCHEMAS = {
    "p1_found": "table_name string, record_id bigint, field string, pos bigint, token string",
    "p2_found": "title string, field string, cand_id bigint",
    "p8_ids": "doc_id bigint, ids array<int>",
    "p9_found": "doc_id bigint, item_id bigint",
    "p10_found": "doc_id bigint, level bigint",
}


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_schema(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == SCHEMAS[name]
    assert df.count() == df.distinct().count() or name == "p8_ids"


def test_reports_agree_with_the_rows_they_count(spark):
    """p1_unmatched, p9_items and p8_lengths count what the queries of rows give."""
    q = queries.QUERIES
    assert sum(r["rows"] for r in q["p1_unmatched"](spark, FOLDER).collect()) == q["p1_found"](spark, FOLDER).where("token = ''").count()
    per = {r.item_id: r["count"] for r in q["p9_found"](spark, FOLDER).groupBy("item_id").count().collect()}
    assert {r.item_id: r.documents for r in q["p9_items"](spark, FOLDER).collect()} == per
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source").collect()}
    sizes: dict = {}
    for r in q["p8_ids"](spark, FOLDER).collect():
        documents, tokens = sizes.get(sources[r.doc_id], (0, 0))
        sizes[sources[r.doc_id]] = (documents + 1, tokens + len(r.ids))
    assert {r.source: (r.documents, r.tokens) for r in q["p8_lengths"](spark, FOLDER).collect()} == sizes
