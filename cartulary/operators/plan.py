"""Write plans: output paths, conflicts, letter folders, playlists, decisions and clean-up."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions import names as N
from cartulary.operators.matching import ARCHIVE_PATTERN
from cartulary.operators.ranks import ranked

#: Tokens of an output template and the columns that fill them.
TOKENS = {
    "{datId}": "dat_id", "{region}": "region", "{language}": "language", "{type}": "type", "{category}": "one_category", "{genre}": "genre",
    "{letter}": "letter", "{datName}": "dat_name", "{datDescription}": "dat_description", "{inputDirname}": "input_dir", "{outputBasename}": "basename",
    "{outputName}": "stem", "{outputExt}": "ext",
    **{f"{{{t}}}": f"platform_{t}" for t in (
        "adam", "batocera", "es", "funkeyos", "jelos", "minui", "mister", "miyoocfw", "onion", "pocket", "retrodeck", "romm", "spruce", "twmenu")},
}
#: Columns in which separators become underscores before they fill a token.
FLAT = ("dat_name", "dat_description")


def expanded(entries: DataFrame) -> DataFrame:
    """One row for each region, language and category of an entry; a null where it has none."""
    name, release = F.col("name"), F.col("release")
    return (
        entries.withColumn("region", F.explode_outer(N.regions(name, release)))
        .withColumn("language", F.explode_outer(N.languages(name, release)))
        .withColumn("one_category", F.explode_outer("category"))
    )


def generate_plan(entries: DataFrame, members: DataFrame, matches: DataFrame, files: DataFrame, incomplete: bool = False) -> DataFrame:
    """``dat_id, game_id, rom_id, file_id, ...``: a row for each member of an entry and its file.

    Entries that lack a member are left out unless ``incomplete``.  Members of size 0
    need no file (``file_id`` null): an empty file always exists.
    """
    source = matches.join(files.select(F.col("file_id").alias("f_id"), "source", "relative"), F.col("file_id") == F.col("f_id")).select(
        F.col("rom_id").alias("m_id"), "file_id", "source", "relative", "tier")
    rows = members.select("game_id", "rom_id", F.col("name").alias("member"), "size", "identity", "kind").join(source, F.col("rom_id") == F.col("m_id"), "left").drop("m_id")
    rows = rows.withColumn("matched", F.col("file_id").isNotNull() | F.coalesce(F.col("size") == 0, F.lit(False)))
    counts = rows.groupBy(F.col("game_id").alias("c_id")).agg(F.count("*").alias("members"), F.count_if("matched").alias("found"))
    wanted = counts if incomplete else counts.where(F.col("members") == F.col("found"))
    kept = rows.where("matched").join(wanted, F.col("game_id") == F.col("c_id")).drop("c_id", "matched", "found")
    return kept.join(entries.select(F.col("game_id").alias("e_id"), "dat_id", F.col("name").alias("entry"), "genre", "category", "release", "isbios", "isdevice", "manufacturer"), F.col("game_id") == F.col("e_id")).drop("e_id")


def output_paths(plan: DataFrame, template: str = "out/{type}", zipped: bool = False) -> DataFrame:
    """``plan`` with ``output`` and ``entry_path``; ``valid`` is false where a token of the template found no value.

    Loose members of entries with several get a folder of the entry's name; disks
    always.  Zipped sets take the entry's name.  Illegal characters are replaced.  A
    token whose column the plan lacks, such as a platform's folder, finds no value.
    """
    base = F.regexp_extract(N.legal_path(F.col("member")), r"([^/]*)$", 1)
    set_name = F.when(F.lit(zipped) & (F.col("kind") != "disk"), F.concat("entry", F.lit(".zip"))).otherwise(base)
    rows = plan.withColumn("basename", set_name).withColumn("stem", N.file_stem(F.col("basename"))).withColumn("ext", F.regexp_extract("basename", r"(\.[^.]*)$", 1))
    rows = rows.withColumn("type", N.entry_type(F.col("entry"), F.col("isbios"), F.col("isdevice"), F.col("category"), F.col("manufacturer")))
    rows = rows.withColumn("input_dir", F.regexp_extract("relative", r"^(.*)/[^/]*$", 1))
    folder = F.lit(template)
    for token, column in TOKENS.items():
        if token in template and column in rows.columns:
            value = F.col(column).cast("string")
            if column == "ext":
                value = F.coalesce(F.nullif(F.regexp_replace(value, r"^\.", ""), F.lit("")), F.lit("-"))
            if column in FLAT:
                value = F.translate(value, "/\\", "__")
            folder = F.when((value != "") & value.isNotNull(), F.replace(folder, F.lit(token), value)).otherwise(folder)
    inside = F.when((F.col("kind") == "disk") | (~F.lit(zipped) & (F.col("members") > 1) & ~F.col("basename").rlike(ARCHIVE_PATTERN)), F.concat_ws("/", "entry", "basename")).otherwise(F.col("basename"))
    output = N.legal_path(F.concat_ws("/", folder, inside))
    return rows.withColumn("output", output).withColumn("entry_path", base).withColumn("valid", ~output.rlike(r"\{[a-zA-Z]+\}"))


def expanded_plan(entries: DataFrame, plan: DataFrame, template: str, zipped: bool = False) -> DataFrame:
    """Output paths of a plan for each region, language and category of an entry; paths that come out alike are one row."""
    parts = expanded(entries).select(F.col("game_id").alias("x_id"), "region", "language", "one_category").distinct()
    rows = output_paths(plan.join(parts, F.col("game_id") == F.col("x_id")).drop("x_id"), template, zipped)
    return rows.where("valid").select("game_id", "rom_id", "file_id", "output").distinct()


def output_conflicts(plan: DataFrame) -> DataFrame:
    """``dat_id, output, entries, inputs``: paths that more than one entry, or more than one file, would be written to."""
    per = plan.groupBy("dat_id", "output").agg(F.count_distinct("game_id").alias("entries"), F.count_distinct("identity").alias("inputs"))
    return per.where((F.col("entries") > 1) | (F.col("inputs") > 1))


def valid_plan(plan: DataFrame) -> DataFrame:
    """The plan of the catalogs in which no path is written by two entries; one conflict empties a catalog."""
    bad = output_conflicts(plan).where(F.col("entries") > 1).select(F.col("dat_id").alias("bad_dat")).distinct()
    return plan.where("valid").join(bad, F.col("dat_id") == F.col("bad_dat"), "left_anti")


def letter_folders(names: DataFrame, limit: int, grouped: bool = False) -> DataFrame:
    """``scope, name, folder``: letter folders of at most ``limit`` names, per scope.

    Ungrouped, a letter with more names is split to ``A1``, ``A2``...; grouped, runs of
    ``limit`` names in order of letter and name share ``A-C``.  Neither a scope nor a
    letter nor a beginning that many names share is sorted in one task (``ranked``).
    """
    letters = names.select("scope", "name").distinct().withColumn("letter", N.letter_of(F.col("name"), 1, grouped))
    placed = ranked(letters, ["scope"] if grouped else ["scope", "letter"], ["letter", "name"] if grouped else ["name"])
    chunk = placed.withColumn("chunk", F.floor(F.col("rank") / limit))
    if grouped:
        ends = chunk.groupBy(F.col("scope").alias("e_scope"), F.col("chunk").alias("e_chunk")).agg(F.concat(F.min("letter"), F.lit("-"), F.max("letter")).alias("folder"))
        return chunk.join(ends, F.col("scope").eqNullSafe(F.col("e_scope")) & (F.col("chunk") == F.col("e_chunk"))).select("scope", "name", "folder")
    totals = chunk.groupBy(F.col("scope").alias("t_scope"), F.col("letter").alias("t_letter")).agg(F.count("*").alias("total"))
    met = chunk.join(totals, F.col("scope").eqNullSafe(F.col("t_scope")) & (F.col("letter") == F.col("t_letter")))
    label = F.when(F.col("total") > limit, F.concat("letter", (F.col("chunk") + 1).cast("string"))).otherwise(F.col("letter"))
    return met.select("scope", "name", label.alias("folder"))


def letter_ranges(names: DataFrame, limit: int) -> DataFrame:
    """``letter, folder``: runs of ``limit`` letters (not names) that share a folder; letters are few."""
    letters = names.select(N.letter_of(F.col("name")).alias("letter")).distinct()
    ranked = letters.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy("letter")) - 1) / limit))
    return ranked.select("letter", F.concat(F.min("letter").over(Window.partitionBy("chunk")), F.lit("-"), F.max("letter").over(Window.partitionBy("chunk"))).alias("folder"))


def playlists(plan: DataFrame) -> DataFrame:
    """``dat_id, title, files, lines``: sets of two or more different files of one title without disc numbers."""
    rows = plan.select("dat_id", N.strip_disc(F.col("entry")).alias("title"), "output").distinct()
    return rows.groupBy("dat_id", "title").agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_list("output")), "\n").alias("lines")).where(F.col("files") > 1)


def playlist_lines(plan: DataFrame, extensions: tuple[str, ...] = ()) -> DataFrame:
    """``dat_id, path, line``: the lines of each playlist of two or more files of one title, as a row each.

    A playlist lies in the folder that its files have in common and names them from
    there; ``extensions`` restricts the files.  What all folders of a title begin with
    is what the least and the greatest of them begin with, so none are collected.
    """
    rows = plan.select("dat_id", N.strip_disc(F.col("entry")).alias("title"), "output").distinct()
    if extensions:
        rows = rows.where(F.lower("output").rlike("(" + "|".join(re.escape(x.lower()) for x in extensions) + ")$"))
    folder = F.concat(F.regexp_extract("output", r"^(.*)/[^/]*$", 1), F.lit("/"))
    ends = rows.groupBy(F.col("dat_id").alias("e_dat"), F.col("title").alias("e_title")).agg(F.count("*").alias("files"), F.min(folder).alias("lo"), F.max(folder).alias("hi"))
    lo, hi = F.split("lo", "/"), F.split("hi", "/")
    alike = F.zip_with(lo, hi, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(alike, F.lit(False))
    same = F.when(first > 0, first - 1).otherwise(F.size(alike)).cast("int")
    common = F.regexp_replace(F.array_join(F.slice(lo, 1, same), "/"), "/$", "")
    heads = ends.where(F.col("files") > 1).select("e_dat", "e_title", common.alias("folder"))
    met = rows.join(heads, F.col("dat_id").eqNullSafe(F.col("e_dat")) & (F.col("title") == F.col("e_title")))
    line = F.regexp_replace(F.substring("output", F.length("folder") + 1, F.length("output")), "^/", "")
    return met.select("dat_id", F.concat_ws("/", F.nullif("folder", F.lit("")), F.concat("title", F.lit(".m3u"))).alias("path"), line.alias("line"))


def write_decision(exists: Column, same: Column, writing: bool, overwrite: bool, overwrite_invalid: bool, passes: Column) -> Column:
    """What happens to an output path, as the first rule that holds."""
    decision = F.when(F.lit(writing) & same, "skip_same")
    if writing and not overwrite and not overwrite_invalid:
        decision = decision.when(exists, "skip_exists")
    if writing and overwrite_invalid:
        decision = decision.when(exists & passes, "skip_valid")
    if not writing:
        return F.when(exists & ~passes, "report_error").otherwise("none")
    return decision.otherwise("write")


def content_test(expected: dict[str, Column], actual: dict[str, Column]) -> Column:
    """True unless a digest that both sides know differs, or the size does; null digests never fail."""
    ok = F.lit(True)
    for name in ("sha256", "sha1", "md5", "crc32"):
        if name in expected and name in actual:
            ok = ok & F.coalesce(expected[name] == actual[name], F.lit(True))
    if "size" in expected and "size" in actual:
        ok = ok & (F.coalesce(expected["size"] == actual["size"], F.lit(True)) | expected.get("crc32", F.lit(None)).isNull())
    return ok


def clean_candidates(existing: DataFrame, written: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Files of the output (``path``) that no plan wrote and no exclusion protects."""
    left = existing.join(written.select(F.col("path").alias("w")).distinct(), F.col("path") == F.col("w"), "left_anti")
    return left if excluded is None else left.join(excluded.select(F.col("path").alias("x")).distinct(), F.col("path") == F.col("x"), "left_anti")


def infer_catalog(files: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """``source, entry, file_id, member``: a catalog made from files by stages, each of which takes its files from the next.

    First the files of archives and folders, an entry for each; then, of the others,
    disc sheets (``sheets``: path, text) with the tracks they list, an entry of the
    sheet's name; then single files by their stem.  With sheets, folders are no entries.
    """
    folder = F.regexp_extract("relative", r"^(.*)/[^/]*$", 1)
    member = F.regexp_extract("relative", r"([^/]*)$", 1).alias("member")
    if sheets is None:
        entry = F.when(folder != "", N.file_stem(folder)).otherwise(N.file_stem(F.col("relative")))
        return files.select("source", entry.alias("entry"), "file_id", member)
    archived = F.col("relative").rlike(ARCHIVE_PATTERN.replace("$", "/"))
    head = F.regexp_extract("relative", ARCHIVE_PATTERN.replace("(?i)", "(?i)^(.*?").replace("$", ")(?=/)"), 1)
    of_archives = files.where(archived).select("source", N.file_stem(head).alias("entry"), "file_id", member)
    rest = files.where(~archived).withColumn("path", F.concat("source", F.lit("/"), "relative"))
    tracks = sheet_files(sheets, rest.select("file_id", "path"))
    own = rest.join(sheets.select(F.col("path").alias("s_path")).distinct(), F.col("path") == F.col("s_path")).select(F.col("file_id").alias("t_id"), F.col("s_path").alias("sheet"))
    used = tracks.select(F.col("file_id").alias("t_id"), "sheet").unionByName(own.join(tracks.select("sheet").distinct(), "sheet", "left_semi").select("t_id", "sheet"))
    of_sheets = rest.join(used, F.col("file_id") == F.col("t_id")).select("source", N.file_stem(F.col("sheet")).alias("entry"), "file_id", member).distinct()
    single = rest.join(used.select("t_id").distinct(), F.col("file_id") == F.col("t_id"), "left_anti").select("source", N.file_stem(F.col("relative")).alias("entry"), "file_id", member)
    return of_archives.unionByName(of_sheets).unionByName(single)


def sheet_files(sheets: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, sheet``: the files (``file_id, path``) that disc sheets (``path, text``) list in their own folder."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    named = sheet_tracks(sheets).select(F.col("path").alias("sheet"), F.concat(folder, F.lit("/"), "track").alias("t_path")).distinct()
    return files.join(named, F.col("path") == F.col("t_path")).select("file_id", "sheet")


def sheet_tracks(sheets: DataFrame) -> DataFrame:
    """``path, pos, track``: files that disc sheets (``path, text``) list; FILE lines of cue, fourth column on of gdi."""
    lines = sheets.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    cue = F.regexp_extract("line", r'(?i)^\s*FILE\s+"?([^"]+?)"?\s+[A-Z0-9]+\s*$', 1)
    gdi = F.regexp_extract("line", r'^\s*\d+\s+\d+\s+\d+\s+\d+\s+"?([^"]+?)"?\s+-?\d+\s*$', 1)
    track = F.when(F.lower("path").endswith(".cue"), cue).otherwise(gdi)
    return lines.select("path", "pos", track.alias("track")).where(F.col("track") != "")
