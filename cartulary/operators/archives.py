"""Archives as inputs: the one that holds every member of an entry, its excess, and what may be copied as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators.matching import tier_keys


def archive_choice(entries: DataFrame, members: DataFrame, contents: DataFrame, zipped: bool = False, excess: bool = True) -> DataFrame:
    """``game_id, archive, members, held, excess``: the archive that holds every member of an entry.

    ``contents``: scanned files with ``archive`` (null for loose files).  An archive
    holds a member if one of its files has the digest of the member's strongest tier that
    any file has.  Preferred are archives of fewer files, then CHD images, then those
    whose name has the entry's, then the smaller path; ``zipped`` admits zip archives
    alone, and without ``excess`` only archives that hold nothing else.  Entries of
    which a member has no file, and those without members, have no archive.

    An entry's archives are named by the member whose digest is in the fewest archives,
    and only they meet its other members, so a digest in every archive names none.
    """
    held = contents.where(F.col("archive").isNotNull())
    if zipped:
        held = held.where(F.lower("archive").endswith(".zip"))
    sizes = held.groupBy(F.col("archive").alias("s_archive")).agg(F.count_distinct("file_id").alias("held"))
    keys = tier_keys(held, "archive").distinct()
    known = tier_keys(contents, "file_id").groupBy("tier", "key").agg(F.count("*").alias("files")).select("tier", "key")
    spread = keys.groupBy("tier", "key").agg(F.count("*").alias("archives"))
    wanted = (
        tier_keys(members.where(F.col("kind") != "disk"), "game_id", "rom_id").join(known, ["tier", "key"])
        .groupBy("game_id", "rom_id").agg(F.min(F.struct("tier", "key")).alias("k")).select("game_id", "rom_id", "k.*")
    )
    counts = members.where(F.col("kind") != "disk").groupBy(F.col("game_id").alias("c_id")).agg(F.count_distinct("rom_id").alias("members"))
    rarest = wanted.join(spread, ["tier", "key"]).groupBy("game_id").agg(F.min(F.struct("archives", "tier", "key")).alias("r")).select("game_id", "r.tier", "r.key")
    named = rarest.join(keys, ["tier", "key"]).select("game_id", "archive")
    met = named.join(wanted, "game_id").join(keys, ["archive", "tier", "key"], "left_semi").groupBy("game_id", "archive").agg(
        F.count_distinct("rom_id").alias("found"), F.count_distinct("tier", "key").alias("digests"))
    full = met.join(counts, (F.col("game_id") == F.col("c_id")) & (F.col("found") == F.col("members"))).join(sizes, F.col("archive") == F.col("s_archive"))
    full = full.withColumn("excess", F.greatest(F.col("held") - F.col("digests"), F.lit(0)))
    if not excess:
        full = full.where(F.col("excess") == 0)
    titled = full.join(entries.select(F.col("game_id").alias("e_id"), F.col("name").alias("entry")), F.col("game_id") == F.col("e_id"))
    other = (~F.lower("archive").endswith(".chd")).cast("int")
    strange = (~F.coalesce(F.regexp_extract("archive", r"([^/]*)$", 1).contains(F.col("entry")), F.lit(False))).cast("int")
    best = titled.groupBy("game_id").agg(F.min(F.struct("held", other.alias("o"), strange.alias("s"), "archive", "members", "excess")).alias("b"))
    return best.select("game_id", "b.archive", "b.members", "b.held", "b.excess")


def legal_inputs(plan: DataFrame, raw: bool) -> DataFrame:
    """Rows of a plan (``member, archive, inside``) whose input can be used: an archive that is copied as it is must have the member under its own name."""
    if not raw:
        return plan
    name = F.regexp_replace("member", r"[\\]", "/")
    return plan.where(F.col("archive").isNull() | (F.col("inside") == name))


def raw_archives(plan: DataFrame) -> DataFrame:
    """``game_id, archive``: entries whose planned members all lie in one archive under their own names, so that it can be copied as it is."""
    name = F.regexp_replace("member", r"[\\]", "/")
    per = plan.where(F.col("kind") != "disk").groupBy("game_id").agg(
        F.bool_and(F.coalesce(F.col("inside") == name, F.lit(False)) & F.col("archive").isNotNull()).alias("own"), F.min("archive").alias("archive"), F.max("archive").alias("last"))
    return per.where(F.col("own") & (F.col("archive") == F.col("last"))).select("game_id", "archive")


def missing_dependencies(entries: DataFrame, planned: DataFrame, mode: str = "split", devices: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """``dat_id, game_id, missing``: names that planned entries (``game_id``) depend on and that are not planned.

    Under ``split`` that is the entry they are a clone of; under all modes but
    ``fullnonmerged`` also the devices they refer to (``devices``: game_id, device)
    that the catalog has with members.
    """
    have = entries.join(planned.select(F.col("game_id").alias("p_id")).distinct(), F.col("game_id") == F.col("p_id"), "left_semi")
    names = have.select(F.col("dat_id").alias("h_dat"), F.col("name").alias("h_name")).distinct()
    asks = have.select("dat_id", "game_id", F.col("cloneof").alias("missing")).where(F.col("missing").isNotNull()) if mode == "split" else have.limit(0).select("dat_id", "game_id", F.col("cloneof").alias("missing"))
    if devices is not None and members is not None and mode != "fullnonmerged":
        full = entries.join(members.where(F.col("kind") != "disk").select(F.col("game_id").alias("m_id")).distinct(), F.col("game_id") == F.col("m_id"), "left_semi")
        known = full.select(F.col("dat_id").alias("v_dat"), F.col("name").alias("v_name")).distinct()
        uses = have.select("dat_id", "game_id").join(devices.select(F.col("game_id").alias("u_id"), F.col("device").alias("missing")).distinct(), F.col("game_id") == F.col("u_id")).drop("u_id")
        asks = asks.unionByName(uses.join(known, (F.col("dat_id") == F.col("v_dat")) & (F.col("missing") == F.col("v_name")), "left_semi"))
    return asks.join(names, (F.col("dat_id") == F.col("h_dat")) & (F.col("missing") == F.col("h_name")), "left_anti").distinct()


def combined_plan(plan: DataFrame, names: DataFrame) -> DataFrame:
    """A plan with every catalog as one archive of the catalog's name (``names``: dat_id, dat_name).

    Members of entries that have several go into a folder of the entry's name; disks,
    which are not zipped, stay where they are.
    """
    named = plan.join(names.select(F.col("dat_id").alias("n_dat"), "dat_name"), F.col("dat_id") == F.col("n_dat")).drop("n_dat")
    zipped = F.col("kind") != "disk"
    inside = F.when(zipped & (F.col("members") > 1), F.concat("entry", F.lit("/"), "entry_path")).otherwise(F.col("entry_path"))
    return named.withColumn("output", F.when(zipped, F.concat("dat_name", F.lit(".zip"))).otherwise(F.col("output"))).withColumn("entry_path", inside)
