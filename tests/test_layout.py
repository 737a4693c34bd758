from __future__ import annotations

import datetime as dt
import os
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from cartulary import session
from cartulary.functions import paths as L
from cartulary.operators import archives as A
from cartulary.operators import matching as M
from cartulary.operators import plan as P
from cartulary.options import Options
from cartulary.plans import sinks
from cartulary.plans.pipeline import organize
from cartulary.sources import assets
from cartulary.sources import catalogs as X

FILE = "file_id bigint, source string, relative string, size bigint, crc32 string, md5 string, sha1 string, sha256 string"


def value(spark, column, **row):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "want"),
    [("  Maker - Box - - Second ", "Maker - Box - Second"), ("- Box -", "Box"), ("A   B", "A B"), ("", ""), ("A - -  - B", "A - B")],
)
def test_display_names(spark, name, want):
    assert value(spark, L.display_name(F.col("n")), n=name) == want


def test_catalog_files_and_segments(spark):
    name = lambda n, v: value(spark, L.catalog_filename(F.col("n"), F.col("v")), n=n, v=v)
    assert [name("Maker: Box", "1/2"), name("Box ", ""), name("Box", None)] == ["Maker; Box (1/2).dat", "Box.dat", "Box.dat"]
    cases = {" a/b\\c ": "a_b_c", "..x..": "x", "--x-": "x", ". -. ": " -", "\t\x00": None, "": None, "a\x07b": "ab"}
    got = {c: value(spark, L.segment(F.col("n")), n=c) for c in cases}
    assert got[" a/b\\c "] == "a_b_c" and got["..x.."] == "x" and got["--x-"] == "x" and got["\t\x00"] is None and got[""] is None and got["a\x07b"] == "ab"


def test_kept_names_and_entry_paths(spark):
    kept = lambda e, p: value(spark, L.kept_basename(F.col("e"), F.col("p"), F.lit(".zip")), e=e, p=p)
    assert [kept("Game", "/in/x.nes.zip"), kept("Game.nes", "/in/x.nes.zip"), kept("Game", "/in/x"), kept("Game", "/in/x.7z")] == ["Game.nes.zip", "Game.nes.zip", "Game.zip", "Game.7z"]
    inside = lambda e, m: value(spark, L.entry_path(F.col("e"), F.col("m")), e=e, m=m)
    assert [inside("a\\b\\Game", "a/b/x.bin"), inside("Game", "a/x.bin"), inside("a/Game", "z/a/x.bin")] == ["x.bin", "a/x.bin", "z/x.bin"]
    mirrored = lambda p: value(spark, L.mirrored_folder(F.col("p"), ("/in/a", "/in")), p=p)
    assert [mirrored("/in/a/b/x"), mirrored("/in/x"), mirrored("/in/c/x"), mirrored("/out/x"), mirrored("/x")] == ["b", ".", "c", "/out", "/"]


@pytest.mark.parametrize(
    ("glob", "fits", "fails"),
    [("**/*.zip", ["a.zip", "a/b/c.zip"], ["a.zipx", "zip"]), ("a/*.{7z,rar}", ["a/x.7z", "a/.rar"], ["a/b/x.7z"]), ("x?[!0-9].b", ["xab.b"], ["xa1.b", "xb.b"]), ("lit\\*", ["lit*"], ["lita"]), ("/in/**", ["/in/a/b"], ["/on/a"]), ("a.b", ["a.b"], ["axb"])],
)
def test_globs(glob, fits, fails):
    pattern = re.compile(L.glob_pattern(glob))
    assert all(pattern.match(x) for x in fits) and not any(pattern.match(x) for x in fails)


def test_literal_paths_win_over_globs(spark):
    df = spark.createDataFrame([("a[1].zip",), ("a1.zip",), (None,)], "p string")
    assert {r.p for r in df.where(L.matches_globs(F.col("p"), ("a[1].zip",))).collect()} == {"a[1].zip", "a1.zip"}


def test_report_paths_and_parts():
    now = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert L.report_path("r_%YYYY-%MM-%DDT%HH:%mm:%ss.csv", now) == "r_2024-01-02T03;04;05.csv"
    assert L.report_path("plain?", now) == "plain_" and L.report_path("%M-%Q", now) == "1-Q"


def test_multi_file_keys(spark):
    cases = {"Game Disc 1": "Game", "Game - Disc 2": "Game", "Game (1)": "Game", "Game - Part 1": "Game", "one": "One", "": "", "A (x) (2)": "A (x)"}
    df = spark.createDataFrame([(c,) for c in cases], "n string")
    assert {r.n: r.k for r in df.select("n", L.multi_file_key(F.col("n")).alias("k")).collect()} == cases


def test_prefixes_overlap_and_are_plain_beginnings(spark):
    files = spark.createDataFrame([(1, "/in/a/x"), (2, "/in/ab/x"), (3, "/out/x"), (4, None)], "file_id bigint, path string")
    prefixes = spark.createDataFrame([("/in", "all"), ("/in/a", "a"), (None, "none"), ("/in/a", "a")], "prefix string, label string")
    assert sorted((r.file_id, r.label) for r in M.assign_by_prefix(files, prefixes, "?").collect()) == [(1, "a"), (1, "all"), (2, "a"), (2, "all"), (3, "?"), (4, "?")]
    assert {r.label for r in M.assign_by_prefix(files, prefixes.limit(0)).collect()} == {""}


MEMBER = "dat_id bigint, game_id bigint, rom_id bigint, ord int, kind string, name string, size bigint, crc32 string, md5 string, sha1 string, sha256 string, status string, merge string, bios string, identity string"


def member(rom, game, sha1, size=1, kind="rom"):
    return (1, game, rom, rom, kind, f"m{rom}.bin", size, None, None, sha1, None, None, None, None, sha1)


def test_variants_of_a_file_come_after_raw_ones(spark):
    files = M.scanned_files(spark.createDataFrame([(1, "s", "a.nes", 5, None, None, "a" * 40, None), (2, "s", "b.nes", 5, None, None, "b" * 40, None), (3, "s", "c.gba", 3, None, None, "c" * 40, None)], FILE))
    behind = F.when(F.col("file_id") == 1, "b" * 40).when(F.col("file_id") == 2, "d" * 40)
    files = files.withColumns({"sha1_headerless": behind, **{f"{x}_headerless": F.lit(None).cast("string") for x in ("crc32", "md5", "sha256")}})
    padded = F.struct(F.lit(4).cast("bigint").alias("padded_size"), F.lit(0).alias("fill"), *[F.lit(None).cast("string").alias(x) for x in ("crc32", "md5")], F.lit("e" * 40).alias("sha1"), F.lit(None).cast("string").alias("sha256"))
    files = files.withColumn("paddings", F.when(F.col("file_id") == 3, F.array(padded)))
    roms = spark.createDataFrame([member(10, 1, "b" * 40), member(11, 1, "d" * 40), member(12, 1, "e" * 40), member(13, 1, "f" * 40)], MEMBER)
    got = {r.rom_id: (r.file_id, r.variant) for r in M.variant_match(roms, files).collect()}
    assert got == {10: (2, M.RAW), 11: (2, M.HEADERLESS), 12: (3, M.PADDED)}


def test_archive_choice_dependencies_and_combination(spark):
    entries = spark.createDataFrame([(1, 1, "One", None), (2, 1, "Two", "One"), (3, 1, "Three", None)], "game_id bigint, dat_id bigint, name string, cloneof string")
    members = spark.createDataFrame([member(10, 1, "a"), member(11, 1, "b"), member(20, 2, "a"), member(30, 3, "z")], MEMBER)
    rows = [(1, "/s/One.zip", "a"), (2, "/s/One.zip", "b"), (3, "/s/all.zip", "a"), (4, "/s/all.zip", "b"), (5, "/s/all.zip", "x"), (6, None, "a"), (7, "/s/b.zip", "b"), (8, "/s/a.chd", "a"), (9, "/s/a.zip", "a")]
    contents = spark.createDataFrame([(i, a, 1, None, None, d, None) for i, a, d in rows], "file_id bigint, archive string, size bigint, crc32 string, md5 string, sha1 string, sha256 string")
    got = {r.game_id: (r.archive, r.held, r.excess) for r in A.archive_choice(entries, members, contents).collect()}
    assert got == {1: ("/s/One.zip", 2, 0), 2: ("/s/a.chd", 1, 0)}
    only = {r.game_id: r.archive for r in A.archive_choice(entries, members, contents, zipped=True, excess=False).collect()}
    assert only == {1: "/s/One.zip", 2: "/s/a.zip"}
    planned = entries.where("game_id > 1")
    devices = spark.createDataFrame([(3, "One"), (3, "gone")], "game_id bigint, device string")
    needs = sorted((r.game_id, r.missing) for r in A.missing_dependencies(entries, planned, "split", devices, members).collect())
    assert needs == [(2, "One"), (3, "One")]
    assert [(r.game_id, r.missing) for r in A.missing_dependencies(entries, planned, "merged", devices, members).collect()] == [(3, "One")]
    assert A.missing_dependencies(entries, planned, "fullnonmerged", devices, members).count() == 0
    plan = spark.createDataFrame([(1, "One", "rom", 2, "x.bin", "o/One/x.bin"), (1, "Two", "rom", 1, "y.bin", "o/y.bin"), (1, "Two", "disk", 1, "d", "o/Two/d")], "dat_id bigint, entry string, kind string, members int, entry_path string, output string")
    names = spark.createDataFrame([(1, "Cat")], "dat_id bigint, dat_name string")
    assert sorted((r.output, r.entry_path) for r in A.combined_plan(plan, names).collect()) == [("Cat.zip", "One/x.bin"), ("Cat.zip", "y.bin"), ("o/Two/d", "d")]
    raw = spark.createDataFrame([("x.bin", "a.zip", "x.bin"), ("x.bin", "a.zip", "y.bin"), ("x.bin", None, "z")], "member string, archive string, inside string")
    assert A.legal_inputs(raw, True).count() == 2 and A.legal_inputs(raw, False).count() == 3


def test_catalog_from_files_by_stages(spark):
    files = spark.createDataFrame([(1, "/s", "a.zip/x.bin"), (2, "/s", "d/g.cue"), (3, "/s", "d/t 1.bin"), (4, "/s", "d/other.bin"), (5, "/s", "g.gdi"), (6, "/s", "t2.bin"), (7, "/s", "lone.cue")], "file_id bigint, source string, relative string")
    sheets = spark.createDataFrame([("/s/d/g.cue", 'FILE "t 1.bin" BINARY\nFILE "none.bin" BINARY'), ("/s/g.gdi", "1\n1 0 4 2352 t2.bin 0"), ("/s/lone.cue", 'FILE "none.bin" BINARY')], "path string, text string")
    got = sorted((r.file_id, r.entry) for r in P.infer_catalog(files, sheets).collect())
    assert got == [(1, "a"), (2, "g"), (3, "g"), (4, "other"), (5, "g"), (6, "g"), (7, "lone")]


def test_catalog_texts_of_all_formats(spark):
    xml = '<?xml version="1.0"?>\n<!-- x --><!DOCTYPE datafile [<!ELEMENT a (b)>]>\n<datafile><game name="G &amp; H" cloneof="P"><rom name="a.bin" size="3" crc="AB"/></game><machine name="m"/></datafile>'
    soft = '<softwarelists><softwarelist name="l"><software name="s"><part><dataarea><rom name="r" size="1"/></dataarea></part></software></softwarelist></softwarelists>'
    smdb = "\t".join(["a" * 64, "d/One.bin", "b" * 40, "", "", "7"])
    texts = [("x", xml), ("s", soft), ("c", 'game (\n\tname "C"\n\trom ( name a size 2 )\n)\n'), ("t", smdb), ("bad", "<mame><machine"), ("open", 'game (\n\tname "x'), ("none", "hello"), ("empty", ""), ("null", None)]
    got = {r.path: (r.format, r.name, [(m.name, m["size"]) for m in r.members or []], r.error) for r in X.entries_of_texts(spark.createDataFrame(texts, "path string, value string")).collect()}
    assert got == {
        "x": ("xml", "G & H", [("a.bin", 3)], None), "s": ("xml", "s", [("r", 1)], None), "c": ("cmpro", "C", [("a", 2)], None), "t": ("smdb", "d/One", [("d/One.bin", 7)], None),
        "bad": ("xml", None, [], "broken XML"), "open": ("cmpro", None, [], "unclosed quote"), "none": (None, None, [], "no known format"), "empty": (None, None, [], "no known format"), "null": (None, None, [], "no known format"),
    }


def test_files_are_hashed_in_pieces(spark, tmp_path):
    body = os.urandom((1 << 20) + 17)
    (tmp_path / "a b.bin").write_bytes(body)
    listing = assets.list_files(spark, [str(tmp_path)])
    gone = listing.withColumn("path", F.concat("path", F.lit(".gone")))
    got = {r.error is None: r for r in assets.hash_files(listing.unionByName(gone), ("crc32", "sha1")).collect()}
    want = {**assets._digests(body)}
    assert (got[True]["size"], got[True].crc32, got[True].sha1, got[True].md5) == (len(body), want["crc32"], want["sha1"], None)
    assert got[False].sha1 is None and "Error" in got[False].error


def test_literal_paths_are_listed_before_globs(spark, tmp_path):
    for name in ("a[1].bin", "a1.bin", "b.txt"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda *paths: sorted(r.path.rsplit("/", 1)[-1] for r in assets.list_files(spark, [f"{tmp_path}/{p}" for p in paths]).collect())
    assert names("a[1].bin") == ["a[1].bin"] and names("a[0-9].bin") == ["a1.bin"] and names("*.{bin,txt}") == ["a1.bin", "a[1].bin", "b.txt"] and names("none", "b.txt") == ["b.txt"]
    with pytest.raises(FileNotFoundError):
        names("none*")


def test_scan_of_catalogs(spark, tmp_path):
    files = {
        "1.xml": '<datafile><header><name> Zeta </name><description>d</description><version>2</version></header><game name="z"/></datafile>', "2.xml": '<mame build="alpha 1"><machine name="m"/></mame>',
        "3.xml": '<softwarelists><softwarelist name="l1"><software name="s1"/></softwarelist><softwarelist name="l2"/></softwarelists>', "4.dat": 'clrmamepro (\n\tname "Cm (x)"\n\tversion 3\n)\n\ngame (\n\tname c\n)\n',
        "5.txt": "\t".join(["a" * 64, "o.bin", "", "", "", "1"]), "6.txt": "nothing",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    catalogs, entries = X.scan_catalogs(spark, str(tmp_path), exclude=("^Zeta",))
    assert [(r.name, r.format, r.version) for r in catalogs.collect()] == [("5", "smdb", None), ("alpha 1", "xml", None), ("Cm (x)", "cmpro", "3"), ("l1, l2", "xml", None)]
    assert sorted((r.name or "", r.error) for r in entries.collect()) == [("", "no known format"), ("c", None), ("m", None), ("o", None), ("s1", None)]


def test_expected_outputs_raw_archives_and_masks(spark):
    files = spark.createDataFrame([(1, 5, "c", None, "raw", None, 4, "h", None, "behind", None)], "file_id bigint, size bigint, crc32 string, md5 string, sha1 string, sha256 string, size_headerless bigint, crc32_headerless string, md5_headerless string, sha1_headerless string, sha256_headerless string")
    matches = spark.createDataFrame([(10, 1, 2, M.RAW), (11, 1, 2, M.HEADERLESS), (12, 1, 2, M.PADDED)], "rom_id bigint, file_id bigint, tier int, variant int")
    assert sorted((r.rom_id, r["size"], r.sha1) for r in M.expected_outputs(matches, files).collect()) == [(10, 5, "raw"), (11, 4, "behind")]
    rows = [(1, "rom", "a\\x", "A", "a/x"), (1, "rom", "y", "A", "y"), (1, "disk", "d", None, None), (2, "rom", "x", "A", "x"), (2, "rom", "y", "B", "y"), (3, "rom", "x", "A", "z"), (4, "rom", "x", None, "x")]
    plan = spark.createDataFrame(rows, "game_id bigint, kind string, member string, archive string, inside string")
    assert [(r.game_id, r.archive) for r in A.raw_archives(plan).collect()] == [(1, "A")]
    roms = spark.createDataFrame([member(1, 1, "a")], MEMBER)
    mask = lambda **k: M.required_digests(roms, **k).first()["mask"]
    assert [mask(), mask(patches=True), mask(inferred=True), mask(most="crc32")] == [0x100, 0x101, 0x111, 0x1]


def test_only_trimmable_contents_are_padded(spark):
    gba = bytes(4) + bytes.fromhex("24FFAE51699AA221") + b"x"
    df = spark.createDataFrame([(1, gba), (2, b"plain"), (3, b""), (4, b"four")], "id bigint, content binary")
    got = {r.id: [(p.padded_size, p.fill, p.md5) for p in r.paddings] for r in assets.with_paddings(df).collect()}
    assert [x[:2] for x in got[1]] == [(16, 0), (16, 255)] and got[1][0][2] == assets._digests(gba.ljust(16, b"\0"))["md5"] and not (got[2] or got[3] or got[4])
    forced = {r.id: len(r.paddings) for r in assets.with_paddings(df, F.lit(True)).collect()}
    assert forced == {1: 2, 2: 2, 3: 0, 4: 0}


def test_actions_stay_below_the_root(spark, tmp_path):
    for name, body in (("a.bin", b"aa"), ("b.bin", b"b")):
        (tmp_path / name).write_bytes(body)
    root = tmp_path / "root"
    rows = [(f"{tmp_path}/a.bin", o) for o in ("../out.bin", "/etc/out.bin", "x/../../out.bin", "", "in/ok.bin")]
    done = sinks.execute_plan(spark.createDataFrame(rows, "input string, output string"), str(root), dry_run=False)
    assert sorted(r.result.split(":")[0] for r in done.collect()) == ["done", "refused", "refused", "refused", "refused"]
    assert sorted(str(p.relative_to(root)) for p in root.rglob("*")) == ["in", "in/ok.bin"]
    plan = spark.createDataFrame([(f"{tmp_path}/b.bin", "z/s.zip", "B.bin"), (f"{tmp_path}/a.bin", "z/s.zip", "a.bin")], "input string, output string, entry_path string")
    assert {r.result for r in sinks.execute_plan(plan, str(root), "zip", dry_run=False).collect()} == {"done"}
    with zipfile.ZipFile(root / "z/s.zip") as made:
        assert made.namelist() == ["a.bin", "B.bin"] and made.read("a.bin") == b"aa"
    take = spark.createDataFrame([(f"{root}/z/s.zip", "e/a.bin", "a.bin"), (f"{root}/z/s.zip", "e/none.bin", "none")], "input string, output string, inside string")
    assert sorted(r.result.split(":")[0] for r in sinks.execute_plan(take, str(root), "extract", dry_run=False).collect()) == ["done", "error"]
    assert (root / "e/a.bin").read_bytes() == b"aa"
    sha1 = assets._digests(b"aa")["sha1"]
    tests = spark.createDataFrame([("", "e/a.bin", sha1, 2), ("", "in/ok.bin", sha1, 3), ("", "none", None, None)], "input string, output string, sha1 string, size bigint")
    assert sorted(r.result.split(":")[0] for r in sinks.execute_plan(tests, str(root), "test", dry_run=False).collect()) == ["error", "failed", "passed"]
    moved = spark.createDataFrame([(f"{tmp_path}/a.bin", "m.bin")], "input string, output string")
    first = sinks.execute_plan(moved, str(root), "move", dry_run=False)
    assert [r.result for r in first.collect()] == ["done"] and [r.result for r in first.collect()] == ["done"] and not (tmp_path / "a.bin").exists()


GAMES = ("game_id bigint, dat_id bigint, id string, name string, description string, cloneof string, romof string, cloneofid string, isbios string, isdevice string, manufacturer string, genre string, "
         "category array<string>, release array<struct<name:string,region:string,language:string>>, removed_at timestamp, delivered_at timestamp")  # fmt: skip
ROMS = "rom_id bigint, game_id bigint, dat_id bigint, ord int, kind string, name string, size bigint, crc32 string, md5 string, sha1 string, sha256 string, status string, merge string, bios string, delivered_at timestamp"


def tables(spark):
    game = lambda i, name, cloneof=None, dat=1: (i, dat, None, name, None, cloneof, None, None, None, None, None, None, None, None, None, dt.datetime(2024, 1, 1))
    rom = lambda i, g, sha1, kind="rom", dat=1: (i, g, dat, i, kind, f"r{i}.bin", 1, None, None, sha1, None, None, None, None, dt.datetime(2024, 1, 1))
    games = spark.createDataFrame([game(1, "Parent"), game(2, "Clone", "Parent"), game(3, "Set (Disc 1)"), game(4, "Set (Disc 2)"), game(5, "Parent", dat=2)], GAMES)
    roms = spark.createDataFrame([rom(10, 1, "a" * 40), rom(11, 1, "9" * 40, "disk"), rom(20, 2, "b" * 40), rom(30, 3, "c" * 40), rom(40, 4, "d" * 40), rom(50, 5, "a" * 40, dat=2)], ROMS)
    files = spark.createDataFrame([(i, "s", f"{x}.bin", 1, None, None, x * 40, None) for i, x in enumerate("abcd9")], FILE)
    return games, roms, files


def test_organize_honours_its_options(spark):
    games, roms, files = tables(spark)
    rows = lambda out: sorted((r.dat_id, r.entry, r.output) for r in out.plan.collect())
    plain = organize(games, roms, files, Options())
    assert rows(plain) == [(1, "Clone", "out/Retail/r20.bin"), (1, "Parent", "out/Retail/Parent/r10.bin"), (1, "Parent", "out/Retail/Parent/r11.bin"), (1, "Set (Disc 1)", "out/Retail/r30.bin"), (1, "Set (Disc 2)", "out/Retail/r40.bin"), (2, "Parent", "out/Retail/r50.bin")]
    merged = organize(games, roms, files, Options(merge_mode="merged"))
    assert sorted((r.game_id, r.name) for r in merged.members.where("dat_id = 1").collect()) == [(1, "Clone\\r20.bin"), (1, "r10.bin"), (1, "r11.bin"), (3, "r30.bin"), (4, "r40.bin")]
    assert {r.name: r.status for r in merged.status.collect()}["Parent"] == "FOUND"
    discs = organize(games, roms, files, Options(merge_discs=True))
    assert sorted((r.entry, r.output) for r in discs.plan.where("entry = 'Set'").collect()) == [("Set", "out/Retail/Set/r30.bin"), ("Set", "out/Retail/Set/r40.bin")]
    combined = organize(games, roms, files, Options(combine=True))
    assert sorted((r.dat_id, r.game_id) for r in combined.entries.collect()) == [(0, 1), (0, 2), (0, 3), (0, 4)]
    lettered = organize(games, roms, files, Options(letter_limit=1))
    assert {r.output.split("/")[2] for r in lettered.plan.where("dat_id = 1").collect()} == {"C", "P", "S1", "S2"}
    capped = organize(games, roms, files, Options(digest_max="md5"))
    assert capped.matches.count() == 0
    existing = spark.createDataFrame([("out/Retail/r20.bin", 1, None, None, "b" * 40, None), ("out/Retail/r30.bin", 1, None, None, "f" * 40, None)], "path string, size bigint, crc32 string, md5 string, sha1 string, sha256 string")
    repair = organize(games, roms, files, Options(commands=("copy",), output="o", overwrite_invalid=True), existing=existing)
    assert {r.output.rsplit("/", 1)[-1]: r.decision for r in repair.plan.where("dat_id = 1").collect()} == {"r20.bin": "skip_valid", "r30.bin": "write", "r10.bin": "write", "r11.bin": "write", "r40.bin": "write"}
    keep = organize(games, roms, files, Options(commands=("copy",), output="o"), existing=existing)
    assert {r.decision for r in keep.plan.where("output in ('out/Retail/r20.bin', 'out/Retail/r30.bin')").collect()} == {"skip_exists"}


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    class Frame:
        sparkSession = Session()

    with pytest.raises(RuntimeError):
        session.checkpointed(Frame())
    with pytest.raises(RuntimeError):
        session.written(Frame())
