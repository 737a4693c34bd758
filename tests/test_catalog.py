from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cartulary.functions import names as N
from cartulary.operators import catalog as C
from cartulary.operators import matching as M
from cartulary.operators import plan as P
from cartulary.operators import records as R
from cartulary.operators.ranks import ranked
from cartulary.options import Options

ENTRY = ("game_id bigint, dat_id bigint, id string, name string, description string, cloneof string, romof string, cloneofid string, isbios string, isdevice string, "
         "manufacturer string, genre string, category array<string>, release array<struct<name:string,region:string,language:string>>")  # fmt: skip


def entries(spark, *rows):
    base = dict.fromkeys([c.split()[0] for c in ENTRY.split(", ") if " " in c])
    order = ["game_id", "dat_id", "id", "name", "description", "cloneof", "romof", "cloneofid", "isbios", "isdevice", "manufacturer", "genre", "category", "release"]
    full = [{**base, "dat_id": 1, "game_id": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in order) for r in full], ENTRY)


def one(spark, expression, **row):
    return entries(spark, row).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "revision"),
    [("A (Rev 2)", 2.0), ("A (Version 1.5)", 1.5), ("A (Rev B)", 2.0), ("A v1.2 x", 1.2), ("A (RE)", 1.0), ("A (RE-3)", 3.0), ("A", 0.0), ("A (Rev 1.1.1)", None)],
)
def test_revision(spark, name, revision):
    assert one(spark, N.revision(F.col("name")), name=name) == revision


def test_locales(spark):
    release = [("r", "eur", "En"), ("r", None, None)]
    cases = [("A (USA, Europe) (En,Fr-CA)", ["USA", "EUR"], ["EN", "FR"]), ("A (J)", ["JPN"], ["En"]), ("A (F)", ["FRA"], ["En"]), ("A (Eng-Ger)", ["EUR"], ["EN", "DE"]), ("A", ["EUR"], ["En"]), ("A (Scandinavia)", [""], ["En"])]
    df = entries(spark, *[{"name": n, "release": release} for n, *_ in cases])
    got = df.orderBy("game_id").select(N.regions(F.col("name"), F.col("release")).alias("r"), N.languages(F.col("name"), F.col("release")).alias("l")).collect()
    assert [(list(r.r), list(r.l)) for r in got] == [(r, x) for _, r, x in cases]


def test_strips(spark):
    cases = {"A Game (USA) (En,Fr) (Rev 1) [!]": "A Game", "A (Europe) (Beta 2)": "A", "A (Disc 1)": "A (Disc 1)", "A '94": "A 94", "A v1.2 (1994)(X)": "A (X)", "A [compilation] B [compilation]": "A B"}
    df = entries(spark, *[{"name": n} for n in cases])
    got = [r.x for r in df.orderBy("game_id").select(N.strip_variants(N.strip_locale(F.col("name"))).alias("x")).collect()]
    assert got == list(cases.values())


def test_types_and_flags(spark):
    name = F.col("name")
    kind = N.entry_type(name, F.col("isbios"), F.col("isdevice"), F.col("category"), F.col("manufacturer"))
    cases = [({"name": "A [BIOS]"}, "BIOS"), ({"name": "A (Beta) [!]"}, "Retail"), ({"name": "A (Proto)"}, "Prototype"), ({"name": "A", "category": ["Demos"]}, "Demo"), ({"name": "A [c]"}, "Bad"), ({"name": "A", "isdevice": "yes"}, "Device"), ({"name": "A", "manufacturer": "Hackers"}, "Hacked"), ({"name": "A (Unl)"}, "Unlicensed")]
    got = [r.x for r in entries(spark, *[c for c, _ in cases]).orderBy("game_id").select(kind.alias("x")).collect()]
    assert got == [k for _, k in cases]


def test_prefer_language_beats_region(spark):
    df = C.group_entries(entries(spark, {"name": "A (Japan) (En)"}, {"name": "A (USA) (Fr)", "cloneof": "A (Japan) (En)"}, {"name": "B"}))
    got = {r.group_name: r.name for r in C.prefer(df, C.Preferences(languages=("EN",), regions=("USA",))).collect()}
    assert got == {"A (Japan) (En)": "A (Japan) (En)", "B": "B"}
    other = {r.group_name: r.name for r in C.prefer(df, C.Preferences(regions=("USA",))).collect()}
    assert other["A (Japan) (En)"] == "A (USA) (Fr)"


def test_filters(spark):
    df = C.group_entries(entries(spark, {"name": "A (Demo)"}, {"name": "A (USA)", "cloneof": "A (Demo)"}, {"name": "A (Japan)", "cloneof": "A (Demo)"}))
    got = sorted((r.name, r.parent_name) for r in C.filter_entries(df, C.Filters(no=("demo",))).collect())
    assert got == [("A (Japan)", "A (USA)"), ("A (USA)", "A (USA)")]
    with pytest.raises(ValueError):
        C.Filters(no=("demo",), only=("demo",))


MEMBER = "dat_id bigint, game_id bigint, rom_id bigint, ord int, kind string, name string, size bigint, crc32 string, md5 string, sha1 string, sha256 string, status string, merge string, bios string, identity string"


def members(spark, *rows):
    full = [(1, g, i, i, "rom", n, 1, None, None, None, None, s, m, b, h) for i, (g, n, h, s, m, b) in enumerate(rows)]
    return spark.createDataFrame(full, MEMBER)


def test_merge_modes(spark):
    e = entries(spark, {"name": "bios", "isbios": "yes"}, {"name": "p", "romof": "bios"}, {"name": "c", "cloneof": "p", "romof": "p"}, {"name": "dev", "isdevice": "yes"})
    m = members(spark, (0, "b", "hb", None, None, None), (1, "b", "hb", None, None, "b"), (1, "x", "hx", None, None, None), (1, "n", "hn", "nodump", None, None),
                (2, "y", "hx", None, "x", None), (2, "z", "hz", None, None, None), (2, "b", "hb", None, None, None), (3, "d", "hd", None, None, None))
    got = lambda mode, **k: sorted((r.game_id, r.name) for r in C.merge_split(e, m, mode, **k).collect())
    assert got("nonmerged") == [(0, "b"), (1, "x"), (2, "y"), (2, "z"), (3, "d")]
    assert got("split") == [(0, "b"), (1, "x"), (2, "z"), (3, "d")]
    assert got("merged") == [(0, "b"), (1, "x"), (2, "c\\z"), (3, "d")]
    devices = spark.createDataFrame([(1, "dev"), (1, "dev"), (2, "none")], "game_id bigint, device string")
    assert got("fullnonmerged", devices=devices) == sorted([(0, "b"), (1, "b"), (1, "x"), (2, "y"), (2, "z"), (2, "b"), (3, "d"), (1, "d")])


def test_merged_keeps_disks(spark):
    e = entries(spark, {"name": "p"}, {"name": "c", "cloneof": "p"})
    rows = [(1, g, i, i, k, n, 1, None, None, None, None, None, None, None, h) for i, (g, k, n, h) in enumerate([(0, "rom", "x", "hx"), (0, "disk", "d", "hd"), (1, "rom", "y", "hy"), (1, "disk", "e", "he")])]
    got = sorted((r.game_id, r.kind, r.name) for r in C.merge_split(e, spark.createDataFrame(rows, MEMBER), "merged").collect())
    assert got == [(0, "disk", "d"), (0, "rom", "x"), (1, "rom", "c\\y")]


FILE = "file_id bigint, source string, relative string, size bigint, crc32 string, md5 string, sha1 string, sha256 string"


def test_tiers_usage_and_fuzzy(spark):
    files = M.scanned_files(spark.createDataFrame([(1, "s", "a.zip", 5, "0xAB", None, None, None), (2, "s", "b.bin", 5, "AB", None, None, None), (3, "s", "c.bin", 9, None, None, "f" * 40, None), (4, "s", "The Game (USA).bin", 7, None, None, None, None), (5, "t", "b2.bin", 5, "ab", None, None, None)], FILE))
    roms = spark.createDataFrame([(1, 1, 10, 0, "rom", "b.bin", 5, "000000ab", None, "f" * 40, None, None, None, None, ""), (1, 1, 11, 1, "rom", "b.bin", 5, "000000ab", None, None, None, None, None, None, ""), (1, 1, 12, 2, "rom", "The Game (Europe).bin", 7, None, None, None, None, None, None, None, "")], MEMBER)
    got = {r.rom_id: (r.file_id, r.tier) for r in M.tiered_match(roms, files).collect()}
    assert got == {10: (3, 2), 11: (2, 4)}
    usage = {r.file_id: r.usage for r in M.file_usage(files, M.tiered_match(roms, files)).collect()}
    assert usage == {1: "duplicate", 2: "used", 3: "used", 4: "unused", 5: "duplicate"}
    fuzzy = {r.rom_id: (r.file_id, r.score) for r in M.fuzzy_match(roms, files).collect()}
    assert fuzzy == {10: (2, 1800.0), 11: (2, 1800.0), 12: (4, 320.0)}
    once = {r.rom_id: r.file_id for r in M.assign_once(M.fuzzy_match(roms, files)).collect()}
    assert once == {10: 2, 12: 4}


def test_assignment_goes_on_to_free_files(spark):
    files = M.scanned_files(spark.createDataFrame([(i, "s", f"c{i}.bin", 5, "ab", None, None, None) for i in range(1, 41)], FILE))
    roms = spark.createDataFrame([(1, 1, 100 + i, i, "rom", "b.bin", 5, "000000ab", None, None, None, None, None, None, "") for i in range(45)], MEMBER)
    got = {r.rom_id: r.file_id for r in M.fuzzy_assign(roms, files).collect()}
    by_path = sorted(range(1, 41), key=lambda i: f"s::c{i}.bin")
    assert got == {100 + i: f for i, f in enumerate(by_path)}
    pairs = spark.createDataFrame([(r, f, 100.0) for r in range(30) for f in range(30)], "rom_id bigint, file_id bigint, score double")
    assert {r.rom_id: r.file_id for r in M.assign_once(pairs).collect()} == {i: i for i in range(30)}


def test_partial_titles_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    title = lambda: " ".join(rng.sample(vocabulary, rng.choice((1, 2, 3, 4, 6, 7, 9)))) + rng.choice((" (USA)", ""))
    raw = [(i, "s", f"{title()}.bin", rng.choice((1, 2, None)), None, None, None, None) for i in range(60)]
    names = [(i, f"{title()}.{rng.choice(('bin', 'rom'))}", rng.choice((1, 2, None))) for i in range(80)]
    files = M.scanned_files(spark.createDataFrame(raw, FILE))
    roms = spark.createDataFrame([(1, 1, i, i, "rom", n, s, None, None, None, None, None, None, None, "") for i, n, s in names], MEMBER)
    plain = lambda n: n.rsplit(".", 1)[0].replace("(USA)", "").strip()

    def score(name, size, file):
        a, b = set(plain(name).split()), set(plain(file[2]).split())
        sized = 0 if size is None or size != file[3] else 700 if name == file[2] else 20
        return sized + (300 if plain(name) == plain(file[2]) else len(a & b) / len(a | b) * 300)

    ranked = sorted((-score(n, s, f), i, f"s::{f[2]}", f[0]) for i, n, s in names for f in raw if score(n, s, f) >= 25)
    best, used, once = {}, set(), {}
    for points, i, _, f in ranked:
        best.setdefault(i, (f, round(-points, 6)))
        if i not in once and f not in used:
            once[i] = f
            used.add(f)
    assert len(best) > 70 and {r.rom_id: (r.file_id, r.score) for r in M.fuzzy_match(roms, files).collect()} == best
    assert {r.rom_id: r.file_id for r in M.fuzzy_assign(roms, files).collect()} == once


def test_enrich_needs_equal_sizes_and_own_digests(spark):
    rows = [(1, "s", "a", 5, "aa", "1" * 32, None, None), (2, "s", "b", 6, "aa", "2" * 32, None, None), (3, "s", "c", 5, "aa", None, None, None), (4, "s", "d", 7, "bb", "1" * 32, "4" * 40, None), (5, "s", "e", 0, "cc", "5" * 32, None, None), (6, "s", "f", 0, "cc", None, None, None)]
    got = {r.file_id: (r.crc32, r.md5, r.sha1) for r in M.enrich_digests(M.scanned_files(spark.createDataFrame(rows, FILE))).collect()}
    assert got[1][1] == "1" * 32 and got[2] == ("000000aa", "2" * 32, None) and got[3] == ("000000aa", "1" * 32, None) and got[6][1] is None and got[1][2] == "4" * 40


def test_patches_enrich_and_prefix(spark):
    matched = spark.createDataFrame([(1, "aabbccdd", "x.bin"), (2, "00000000", "y.bin")], "rom_id bigint, crc32 string, name string")
    patches = spark.createDataFrame([("p/Fix AABBCCDD.ips", None, "11111111", 4), ("p/other.bps", "ffffffff", None, None)], "path string, crc_before string, crc_after string, size_after bigint")
    got = sorted((r.rom_id, r.crc32, r.name, r.patched) for r in M.patch_candidates(matched, patches).collect())
    assert got == [(1, "11111111", "Fix AABBCCDD.bin", True), (1, "aabbccdd", "x.bin", False), (2, "00000000", "y.bin", False)]
    cache = spark.createDataFrame([("a", 1, 2, "m"), ("b", 9, 9, "n")], "path string, size bigint, mtime bigint, md5 string")
    files = spark.createDataFrame([("a", 1, 2, None), ("b", 1, 2, None)], "path string, size bigint, mtime bigint, md5 string")
    assert sorted((r.path, r.md5) for r in M.fill_from_cache(files, cache, ("md5",)).collect()) == [("a", "m"), ("b", None)]


def test_variants(spark):
    files = spark.createDataFrame([(1, "A (USA) (Rev 1).zip"), (2, "A (USA) (Rev 2).zip"), (3, "A (Japan).zip"), (4, "B [b1].zip"), (5, "C (Europe) [!].zip"), (6, "C (Europe) (Beta).zip"), (7, "D (x (y) z) [a (b)].zip")], "file_id bigint, relative string")
    rows = R.described(files)
    got = {r.file_id: (r.kept, r.reason) for r in R.choose_variants(rows, ("USA", "EUR"), ("EN",)).collect()}
    assert got[2] == (True, None) and got[1] == (False, "revision") and got[3] == (False, "not in preferences") and got[5] == (True, None) and got[6] == (False, "quality")
    info = {r.file_id: r for r in rows.collect()}
    assert info[7].title == "D" and info[4].quality == "bad" and info[5].region == "EUR"
    assert files.select(N.search_name(F.lit("Big Game (USA) rev 2 1994 NES.zip")).alias("s")).first().s == "Big Game"


@pytest.mark.parametrize(
    ("name", "found", "title"),
    [("A (USA) [!]", ["(USA)", "[!]"], "A"), ("A (x (y) [z]) b [ c ]", ["(x y z)", "[c]"], "A b"), ("A (b] c) d", [], "A c d"), ("A ) (b)", ["(b)"], "A"), ("A ( ) []", [], "A"), ("A (b", [], "A"), ("", [], ""), ("A ((b)", [], "A")],
)
def test_tags_to_any_depth(spark, name, found, title):
    row = spark.range(1).select(N.tags(F.lit(name)).alias("t"), N.bare_title(F.lit(name)).alias("b")).first()
    assert (list(row.t), row.b) == (found, title)


def test_ranks_over_ranges(spark):
    rows = [("hot", f"{i:05}") for i in range(3_000)] + [(None, "b"), (None, "a"), ("x", "y")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "scope string, name string").repartition(5)
    got = {(r.scope, r.name): r["rank"] for r in ranked(df, ["scope"], ["name"]).collect()}
    assert got == {**{("hot", f"{i:05}"): i for i in range(3_000)}, (None, "a"): 0, (None, "b"): 1, ("x", "y"): 0}
    assert P.letter_folders(df.limit(0), 3).count() == 0


def test_playlists_lie_in_the_common_folder(spark):
    rows = [(1, "A (Disc 1)", "out/A (Disc 1)/a.chd"), (1, "A (Disc 2)", "out/A (Disc 2)/a.chd"), (1, "B", "out/b.chd"), (1, "C (Disc 1)", "out/c/1.chd"), (1, "C (Disc 2)", "out/c/2.txt"), (1, "D", "x/d1.chd"), (1, "D", "y/d2.chd"), (1, "A (Disc 1)", "out/A (Disc 1)/a.chd")]
    plan = spark.createDataFrame(rows, "dat_id bigint, entry string, output string")
    got = sorted((r.path, r.line) for r in P.playlist_lines(plan).collect())
    assert got == [("D.m3u", "x/d1.chd"), ("D.m3u", "y/d2.chd"), ("out/A.m3u", "A (Disc 1)/a.chd"), ("out/A.m3u", "A (Disc 2)/a.chd"), ("out/c/C.m3u", "1.chd"), ("out/c/C.m3u", "2.txt")]
    assert {r.path for r in P.playlist_lines(plan, (".chd",)).collect()} == {"D.m3u", "out/A.m3u"}


def test_letters_and_decisions(spark):
    names = spark.createDataFrame([(1, f"{c}{i}") for c in "ab" for i in range(5)] + [(1, "9x"), (2, "a")], "scope bigint, name string")
    got = {(r.scope, r.name): r.folder for r in P.letter_folders(names, 3).collect()}
    assert got[1, "a0"] == "A1" and got[1, "a4"] == "A2" and got[1, "9x"] == "#" and got[2, "a"] == "A"
    grouped = {(r.scope, r.name): r.folder for r in P.letter_folders(names, 4, grouped=True).collect()}
    assert grouped[1, "9x"] == "9-A" and grouped[1, "a3"] == "A-B" and grouped[1, "b4"] == "B-B"
    t, f = F.lit(True), F.lit(False)
    cases = [((t, t, True, True, False, t), "skip_same"), ((t, f, True, False, False, t), "skip_exists"), ((t, f, True, False, True, t), "skip_valid"), ((t, f, False, False, False, f), "report_error"), ((f, f, False, False, False, f), "none"), ((t, f, True, False, True, f), "write")]
    for arguments, want in cases:
        assert spark.range(1).select(P.write_decision(*arguments).alias("d")).first().d == want


def test_sheets_and_options(spark):
    sheets = spark.createDataFrame([("a.cue", 'FILE "x 1.bin" BINARY\n TRACK 01\nFILE y.bin BINARY'), ("b.gdi", "2\n1 0 4 2352 t1.bin 0\n2 600 0 2352 \"t 2.bin\" 0")], "path string, text string")
    assert sorted(r.track for r in P.sheet_tracks(sheets).collect()) == ["t 2.bin", "t1.bin", "x 1.bin", "y.bin"]
    for wrong in ({"commands": ("fly",)}, {"commands": ("copy", "move"), "output": "o"}, {"commands": ("zip",)}, {"digest_min": "sha1", "digest_max": "md5"}, {"letter_group": True}, {"commands": ("copy",)}):
        with pytest.raises(ValueError):
            Options(**wrong)
    assert Options(commands=("copy", "zip"), output="o").merge_mode == "fullnonmerged"


def test_platforms_and_json(spark):
    catalogs = spark.createDataFrame([("Acme - Box Two", ".bin"), ("Other", ".BX"), ("Acme - Box", None), ("None", None)], "name string, extension string")
    table = spark.createDataFrame([(1, "box", "Acme.*Box", [".bx"]), (2, "box2", "Box Two", [".bx", ".b2"]), (3, "x", None, None)], "ord int, platform string, pattern string, extensions array<string>")
    assert [r.platform for r in R.assign_platforms(catalogs, table).collect()] == ["box2", "box", "box", None]
    assert [r.platform for r in R.assign_platforms(catalogs, table, block=1).collect()] == ["box2", "box", "box", None]
    df = spark.createDataFrame([(1, '{"a": {"h": "' + "A" * 40 + '"}}'), (2, None), (3, "b" * 33)], "id bigint, json string")
    assert [(r.sha1, r.md5) for r in R.digests_in_json(df, "id", "json").orderBy("id").collect()] == [("a" * 40, None), (None, None), (None, None)]
