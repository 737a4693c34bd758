from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cartulary.functions.digests import hex_number, normal_digest
from cartulary.operators.diff import compare_copies
from cartulary.operators.entries import in_force
from cartulary.operators.references import catalog_references, orphan_references, orphan_report

SIDE = "id bigint, name string, crc string, row_key string, side string, a int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_compare_copies_states_and_clashing_columns(spark):
    first = spark.createDataFrame([(1, "x", "0x0A", "k", "s", 1), (2, "y", None, None, None, None), (3, "z", "b", None, None, None), (3, "z", "b", None, None, None), (5, None, " ", "", "", 0)], SIDE)
    mirror = spark.createDataFrame([(1, "x", "a ", "other", "t", 2), (2, "Y", "1", None, None, None), (4, "n", None, None, None, None), (5, "v", None, None, None, None)], SIDE)
    got = rows(compare_copies(first, mirror, "id", {"name": None, "crc": hex_number}))
    assert got == [(2, "crc", "differs"), (2, "name", "differs"), (3, "", "only_first"), (4, "", "only_mirror"), (5, "name", "differs")]


def test_compare_copies_tells_rows_that_disagree_within_a_side(spark):
    first = spark.createDataFrame([(1, "x", None, "", "", 1), (1, "y", None, "", "", 1), (2, "x", None, "", "", 1), (3, None, None, "", "", 1), (3, "a", None, "", "", 1)], SIDE)
    mirror = spark.createDataFrame([(1, "y", None, "", "", 1), (2, "x", None, "", "", 1), (2, "x", "1", "", "", 1)], SIDE)
    got = rows(compare_copies(first, mirror, "id", {"name": None, "crc": hex_number}))
    assert got == [(1, "", "unlike_first"), (2, "", "unlike_mirror"), (2, "crc", "differs"), (3, "", "only_first"), (3, "", "unlike_first")]


def test_compare_copies_empty_and_null_keys(spark):
    empty = spark.createDataFrame([], SIDE)
    some = spark.createDataFrame([(None, "x" * 100_000, None, None, None, None)], SIDE)
    assert rows(compare_copies(empty, empty, "id", {"name": None})) == []
    assert [tuple(r) for r in compare_copies(some, empty, "id", {"name": None}).collect()] == [(None, "", "only_first")]
    assert compare_copies(some, some, "id", {"name": None}).count() == 0


def test_hex_number_and_normal_digest(spark):
    df = spark.createDataFrame([("0x0ABC",), (" abc\t",), ("",), (None,), ("000",), ("0x",)], "d string")
    got = [tuple(r) for r in df.select(hex_number(F.col("d")), normal_digest(F.col("d"), "crc32")).collect()]
    assert got[:5] == [("abc", "00000abc"), ("abc", "00000abc"), (None, None), (None, None), ("0", "00000000")]
    assert got[5][0] not in (None, "0")  # no number, but neither blank nor zero


GAMES = "game_id bigint, dat_id bigint, name string, cloneof string, romof string, isbios string, removed_at timestamp, delivered_at timestamp, status string"
ROMS = "rom_id bigint, game_id bigint, dat_id bigint, name string, merge string, bios string, delivered_at timestamp, extra string"
D = [dt.datetime(2023, m, 1) for m in range(1, 13)]


def test_in_force_takes_last_delivery(spark):
    games = spark.createDataFrame([(1, 1, "a", None, None, None, None, D[0], "x"), (1, 1, "b", None, None, None, D[5], D[1], "x"), (None, 1, "n", None, None, None, None, D[0], "x"), (2, 1, "c", None, None, None, None, None, "x"), (2, 1, "c", None, None, None, None, None, "x")], GAMES)
    got = {r.game_id: (r.name, r.removed, r.first_delivered) for r in in_force(games, "dat_id", "name").collect()}
    assert got == {1: ("b", True, D[0]), 2: ("c", False, None)}


def test_references_by_hand(spark):
    games = [
        (1, 1, "bios", None, None, "yes", None, D[0], ""), (2, 1, "parent", None, "bios", None, None, D[0], ""),
        (3, 1, "gone", None, None, None, D[3], D[0], ""), (4, 1, "later", None, None, None, None, D[6], ""),
        (5, 1, "child", "parent", "parent", None, None, D[1], ""), (6, 1, "c2", "gone", "later", None, None, D[1], ""),
        (7, 1, "c3", "nobody", "", None, None, D[1], ""), (8, 2, "c4", "parent", None, None, None, D[1], ""), (9, 1, "dead", "nobody", None, None, D[2], D[1], ""),
    ]
    roms = [
        (20, 2, 1, "a.bin", None, "bios", D[1], ""), (21, 5, 1, "b.bin", "a.bin", "parent", D[1], ""), (21, 5, 1, "b.bin", "a.bin", "parent", D[1], ""),
        (22, 5, 1, "c.bin", "zz.bin", "", D[1], ""), (23, 9, 1, "d.bin", "x", "x", D[1], ""), (24, 99, 1, "e.bin", "q", "bios", D[1], ""), (25, 6, 1, "f.bin", "g.bin", None, D[1], ""),
        (26, 4, 1, "g.bin", None, None, D[6], ""), (27, 7, 1, "h.bin", "i", None, None, ""),
    ]
    entries = in_force(spark.createDataFrame(games, GAMES), "dat_id", "name", "cloneof", "romof", "isbios")
    found = orphan_references(*catalog_references(entries, spark.createDataFrame(roms, ROMS))).select("table_name", "field", "row_key", "state")
    assert rows(found) == [
        ("games", "cloneof", 6, "deleted"), ("games", "cloneof", 7, "missing"), ("games", "cloneof", 8, "missing"), ("games", "romof", 6, "late"),
        ("roms", "bios", 21, "missing"), ("roms", "merge", 22, "missing"), ("roms", "merge", 24, "missing"), ("roms", "merge", 25, "late"), ("roms", "merge", 27, "missing"),
    ]
    report = {(r.table_name, r.field, r.period, r.state): r.references for r in orphan_report(*catalog_references(entries, spark.createDataFrame(roms, ROMS))).collect()}
    assert report == {
        ("games", "cloneof", "2023-02", "deleted"): 1, ("games", "cloneof", "2023-02", "missing"): 2, ("games", "romof", "2023-02", "late"): 1,
        ("roms", "bios", "2023-02", "missing"): 1, ("roms", "merge", "2023-02", "missing"): 2, ("roms", "merge", "2023-02", "late"): 1, ("roms", "merge", None, "missing"): 1}
    none = in_force(spark.createDataFrame([], GAMES), "dat_id", "name", "cloneof", "romof", "isbios")
    assert orphan_references(*catalog_references(none, spark.createDataFrame([], ROMS))).count() == 0
    assert orphan_report(*catalog_references(none, spark.createDataFrame([], ROMS))).count() == 0


def test_report_counts_the_month_in_which_a_parent_came(spark):
    """Of one key: references of months before, within and after the arrival of its parent; a repeated row counts once."""
    at = [dt.datetime(2023, 1, 5), dt.datetime(2023, 2, 5), dt.datetime(2023, 2, 10), dt.datetime(2023, 2, 20), dt.datetime(2023, 3, 1)]
    children = spark.createDataFrame([("t", "f", i, "p", 1, "k", x) for i, x in enumerate([*at, None])] + [("t", "f", 0, "p", 1, "k", at[0])], "table_name string, field string, row_key bigint, parent_table string, k1 bigint, k2 string, at timestamp")
    parents = spark.createDataFrame([("p", 1, "k", True, at[2]), ("p", 1, "k", False, at[0])], "parent_table string, k1 bigint, k2 string, alive boolean, since timestamp")
    got = {(r.period, r.state): r.references for r in orphan_report(parents, children).collect()}
    assert got == {("2023-01", "late"): 1, ("2023-02", "late"): 1}
    assert orphan_references(parents, children).count() == 2


def test_references_hot_key(spark):
    children = spark.range(20_000).select(F.lit("t").alias("parent_table"), F.lit(1).cast("bigint").alias("k1"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k2"), F.current_timestamp().alias("at"), F.col("id").alias("row_key"))
    parents = spark.range(1, 20_000).where("id % 2 = 0").select(F.lit("t").alias("parent_table"), F.lit(1).cast("bigint").alias("k1"), F.col("id").cast("string").alias("k2"), F.lit(True).alias("alive"), F.current_timestamp().alias("since"))
    got = orphan_references(parents, children).where("state = 'missing'")
    assert got.count() == sum(1 for i in range(20_000) if i % 3 == 0 or i % 2)
