"""The chain from catalogs and files to a plan and its status, lazy over all catalogs at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.digests import member_identity
from cartulary.functions.names import strip_disc
from cartulary.operators import catalog as C
from cartulary.operators import matching as M
from cartulary.operators import plan as P
from cartulary.options import DIGEST_ORDER, Options


@dataclass(frozen=True)
class Outcome:
    """What a run finds, as lazy tables."""

    entries: DataFrame
    members: DataFrame
    matches: DataFrame
    status: DataFrame
    plan: DataFrame


def _within(rows: DataFrame, options: Options) -> DataFrame:
    """``rows`` without the digests that the options leave out; weaker ones than the least stay where a row has no other."""
    most = DIGEST_ORDER.index(options.digest_max or "sha256")
    least = DIGEST_ORDER.index(options.digest_min)
    strong = [F.col(d) for d in M.DIGESTS if least <= DIGEST_ORDER.index(d) <= most]
    some = F.coalesce(*strong).isNotNull() if strong else F.lit(False)
    kept = {}
    for d in M.DIGESTS:
        at = DIGEST_ORDER.index(d)
        kept[d] = F.lit(None).cast("string") if at > most else F.when(some, F.lit(None).cast("string")).otherwise(F.col(d)) if at < least else F.col(d)
    rows = rows.withColumns(kept)
    return rows.withColumn("identity", member_identity(*[F.col(d) for d in M.DIGESTS], F.col("size")))


def _merged(entries: DataFrame, members: DataFrame, options: Options, devices: DataFrame | None) -> DataFrame:
    """``members`` under the merge mode: those of the set, below the entry and with the name that the mode gives them."""
    rows = C.merge_split(entries, members, options.merge_mode, devices)
    if options.merge_mode == "merged":
        heads = entries.groupBy(F.col("dat_id").alias("h_dat"), F.col("name").alias("h_name")).agg(F.min("game_id").alias("h_game"))
        rows = rows.join(heads, (F.col("dat_id") == F.col("h_dat")) & (F.col("group_name") == F.col("h_name")), "left").withColumn("game_id", F.coalesce("h_game", "game_id"))
    rows = rows.select(F.col("rom_id").alias("w_id"), F.col("game_id").alias("w_game"), F.col("name").alias("w_name"))
    return members.drop("game_id", "name").join(rows, F.col("rom_id") == F.col("w_id")).withColumnsRenamed({"w_game": "game_id", "w_name": "name"}).drop("w_id")


def _discs(entries: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries that are discs of one title as one entry, the first of them under the title's name, and their members under it."""
    titled = C.merge_discs(entries, members).select(F.col("rom_id").alias("d_rom"), F.col("game_id").alias("d_game"), F.col("name").alias("d_name"))
    title = strip_disc(F.col("name"))
    heads = entries.groupBy("dat_id", title.alias("title")).agg(F.min("game_id").alias("head"))
    of = entries.select(F.col("dat_id").alias("o_dat"), F.col("game_id").alias("o_game"), title.alias("o_title")).join(
        heads, F.col("o_dat").eqNullSafe(F.col("dat_id")) & (F.col("o_title") == F.col("title"))).select("o_game", "head", "title")
    moved = members.join(titled, (F.col("rom_id") == F.col("d_rom")) & (F.col("game_id") == F.col("d_game"))).join(of, F.col("game_id") == F.col("o_game"))
    members = moved.withColumn("game_id", F.col("head")).withColumn("name", F.col("d_name")).drop("d_rom", "d_game", "d_name", "o_game", "head", "title")
    kept = entries.join(of.where(F.col("o_game") == F.col("head")).select("o_game", "title"), F.col("game_id") == F.col("o_game"))
    return kept.withColumn("name", F.col("title")).drop("o_game", "title"), members


def organize(games: DataFrame, roms: DataFrame, files: DataFrame, options: Options, devices: DataFrame | None = None, existing: DataFrame | None = None) -> Outcome:
    """Curate catalogs, match them to files and plan the output, as all of the options say.

    Filters come before matching, so members that are filtered out are never joined; one
    preferred entry per group is kept if ``single`` is set; ``combine`` makes one catalog
    (0) of all, equal entries once; then sets are merged or split (``devices``: game_id,
    device), discs merged, digests kept within the range asked for, and files matched.
    The plan has a folder of letters if ``letter_limit`` is set, and a ``decision`` for
    each path: with the outputs that ``existing`` (``path``, digests, ``size``) holds.
    """
    entries = C.catalog_entries(games)
    kept = C.filter_entries(C.group_entries(entries), options.filters).drop("parent_name")
    if options.single:
        best = C.prefer(kept, options.preferences, C.catalog_members(roms, kept) if options.preferences.member_patterns else None).select(F.col("game_id").alias("b_id"))
        kept = kept.join(best, F.col("game_id") == F.col("b_id"), "left_semi")
    kept = kept.drop("group_name")
    if options.combine:
        first = C.combine_catalogs(kept, C.catalog_members(roms, kept)).select(F.col("game_id").alias("b_id"))
        kept = kept.join(first, F.col("game_id") == F.col("b_id"), "left_semi").withColumn("dat_id", F.lit(0).cast("bigint"))
    members = C.catalog_members(roms, kept)
    members = _merged(kept, members, options, devices)
    if options.merge_discs:
        kept, members = _discs(kept, members)
    members, scanned = _within(members, options), _within(M.scanned_files(files), options)
    matches = M.tiered_match(members, scanned)
    status = M.entry_status(kept, members, matches)
    plan = P.generate_plan(kept, members, matches, scanned, options.allow_incomplete)
    template = options.template
    if options.letter_limit:
        folders = P.letter_folders(plan.select(F.col("dat_id").alias("scope"), F.col("entry").alias("name")), options.letter_limit, options.letter_group)
        named = folders.select(F.col("scope").alias("l_dat"), F.col("name").alias("l_name"), F.col("folder").alias("letter"))
        plan = plan.join(named, F.col("dat_id").eqNullSafe(F.col("l_dat")) & (F.col("entry") == F.col("l_name")), "left").drop("l_dat", "l_name")
        template += "/{letter}"
    plan = P.valid_plan(P.output_paths(plan, template, zipped="zip" in options.commands))
    there = existing if existing is not None else plan.sparkSession.createDataFrame([], "path string, size bigint, crc32 string, md5 string, sha1 string, sha256 string")
    here = there.groupBy(F.col("path").alias("x_path")).agg(*[F.min(c).alias(f"x_{c}") for c in ("size", *M.DIGESTS)])
    wanted = members.select(F.col("rom_id").alias("y_id"), F.col("game_id").alias("y_game"), *[F.col(d).alias(f"y_{d}") for d in M.DIGESTS])
    plan = plan.join(wanted, (F.col("rom_id") == F.col("y_id")) & (F.col("game_id") == F.col("y_game"))).join(here, F.col("output") == F.col("x_path"), "left")
    passes = P.content_test({**{d: F.col(f"y_{d}") for d in M.DIGESTS}, "size": F.col("size")}, {c: F.col(f"x_{c}") for c in (*M.DIGESTS, "size")})
    writing = bool({"copy", "move", "link"} & set(options.commands))
    same = F.coalesce(F.concat("source", F.lit("/"), "relative") == F.col("output"), F.lit(False))
    decision = P.write_decision(F.col("x_path").isNotNull(), same, writing, options.overwrite, options.overwrite_invalid, passes)
    extra = ["y_id", "y_game", "x_path", *[f"y_{d}" for d in M.DIGESTS], *[f"x_{c}" for c in ("size", *M.DIGESTS)]]
    return Outcome(kept, members, matches, status, plan.withColumn("decision", decision).drop(*extra))
