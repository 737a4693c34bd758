"""Columns and types of the found queries."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")

SCHEMAS = {
    "p3_found": "link string, game_id bigint, root_id bigint, depth bigint",
    "p4_found": "table_name string, row_key bigint, field string, state string",
    "p5_found": "table_name string, row_key bigint, pos bigint, value string",
    "p6_found": "table_name string, field string, row_key bigint, period string, state string",
    "p7_found": "raw_id bigint, root string, list_pos bigint, entry_tag string, entry_pos bigint, part_pos bigint, area_pos bigint, kind string, member_pos bigint",
}


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_schema(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == SCHEMAS[name]
