"""Curation of catalogs: groups, parents, discs, filters, preferences, merging and splitting."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import names as N
from cartulary.functions.digests import member_identity, multiset_print, normal_digest
from cartulary.operators.entries import in_force
from cartulary.operators.hierarchy import climb
from cartulary.session import written


ENTRY_COLUMNS = ("dat_id", "id", "name", "description", "cloneof", "romof", "cloneofid", "isbios", "isdevice", "manufacturer", "genre", "category", "release")


def catalog_entries(games: DataFrame, *columns: str) -> DataFrame:
    """Entries in force that are not removed, with the ``columns`` (all by default); others are not read."""
    entries = in_force(games, *(columns or ENTRY_COLUMNS))
    return entries.where(~F.col("removed")).drop("removed", "first_delivered", "delivered_at", *({"removed_at"} - set(columns)))


def catalog_members(roms: DataFrame, entries: DataFrame) -> DataFrame:
    """Members of the entries with normal digests and identity; repeated rows count once.

    Repeats are dropped over all columns, so an entry with a third of all members is
    spread there, and its partition is split by adaptive execution in the join.
    """
    columns = ["rom_id", "game_id", "ord", "kind", "name", "size", "crc32", "md5", "sha1", "sha256", "status", "merge", "bios"]
    rows = roms.where(F.col("game_id").isNotNull()).select(*columns).distinct()
    digests = {d: normal_digest(F.col(d), d) for d in ("crc32", "md5", "sha1", "sha256")}
    kept = entries.select(F.col("game_id").alias("e_id"), F.col("dat_id").alias("e_dat"))
    return (
        rows.join(kept, F.col("game_id") == F.col("e_id"))
        .withColumns(digests)
        .withColumn("identity", member_identity(*[F.col(d) for d in ("crc32", "md5", "sha1", "sha256")], F.col("size")))
        .withColumn("dat_id", F.col("e_dat")).drop("e_id", "e_dat")
    )


def group_entries(entries: DataFrame) -> DataFrame:
    """``entries`` with ``group_name``: the parent by id if given, else by name; orphans group by the missing parent's name.

    The parent is joined on catalog and reference; an entry without reference is its
    own group.  Ties of ids or names go to the smaller game_id.
    """
    by_id = entries.where(F.col("id").isNotNull()).groupBy(F.col("dat_id").alias("i_dat"), F.col("id").alias("i_id")).agg(F.min_by("name", "game_id").alias("i_name"))
    joined = entries.join(by_id, (F.col("dat_id") == F.col("i_dat")) & (F.col("cloneofid") == F.col("i_id")), "left")
    group = F.when(F.col("cloneofid").isNotNull(), F.coalesce("i_name", "cloneof", "name")).otherwise(F.coalesce(F.nullif("cloneof", F.lit("")), "name"))
    return joined.withColumn("group_name", group).drop("i_dat", "i_id", "i_name")


def parent_info(grouped: DataFrame) -> DataFrame:
    """``dat_id, entries, groups, has_parents``: whether a catalog says anything about parents and clones."""
    per = grouped.groupBy("dat_id").agg(F.count("*").alias("entries"), F.count_distinct("group_name").alias("groups"))
    return per.withColumn("has_parents", (F.col("groups") > 0) & (F.col("groups") != F.col("entries")))


def infer_parents(entries: DataFrame) -> DataFrame:
    """``dat_id, game_id, stripped, parent_id``: entries of one stripped title, and the parent elected among them.

    The parent is the first entry whose name without region and language already is
    the stripped title, else the first of the group; first is the smaller game_id.
    """
    plain = entries.select("dat_id", "game_id", N.strip_locale(F.col("name")).alias("plain"))
    named = plain.select("dat_id", "game_id", "plain", N.strip_variants(F.col("plain")).alias("stripped"))
    elected = named.groupBy("dat_id", "stripped").agg(
        F.coalesce(F.min(F.when(F.col("plain") == F.col("stripped"), F.col("game_id"))), F.min("game_id")).alias("parent_id")
    )
    back = elected.select(F.col("dat_id").alias("p_dat"), F.col("stripped").alias("p_stripped"), "parent_id")
    return named.join(back, F.col("dat_id").eqNullSafe(F.col("p_dat")) & F.col("stripped").eqNullSafe(F.col("p_stripped"))).select(
        "dat_id", "game_id", "stripped", "parent_id"
    )


def merge_discs(entries: DataFrame, members: DataFrame) -> DataFrame:
    """``dat_id, title, entries, game_id, rom_id, name``: members under the title without disc numbers.

    Entries of one title become one; member names get the entry's name in front where
    two or more different names of the merged set repeat.
    """
    titled = entries.select("dat_id", "game_id", F.col("name").alias("entry_name"), N.strip_disc(F.col("name")).alias("title"))
    sizes = titled.groupBy("dat_id", "title").agg(F.count("*").alias("entries"))
    rows = titled.join(members.select(F.col("game_id").alias("m_game"), "rom_id", F.col("name").alias("m_name")), F.col("game_id") == F.col("m_game"))
    repeated = rows.groupBy("dat_id", "title", "m_name").agg(F.count("*").alias("n")).groupBy("dat_id", "title").agg(F.count_if(F.col("n") > 1).alias("clashes"))
    extra = sizes.join(repeated, ["dat_id", "title"]).select("dat_id", "title", "entries", "clashes")
    name = F.when((F.col("entries") > 1) & (F.col("clashes") > 1), F.concat("entry_name", F.lit("/"), "m_name")).otherwise(F.col("m_name"))
    return rows.join(extra, ["dat_id", "title"]).select("dat_id", "title", "entries", "game_id", "rom_id", name.alias("name"))


def entry_identity(entries: DataFrame, members: DataFrame) -> DataFrame:
    """``game_id, dat_id, name, identity``: name and fingerprint of the member identities of an entry; disks do not count."""
    listed = members.where(F.col("kind") != "disk").groupBy(F.col("game_id").alias("m_id")).agg(multiset_print(F.col("identity")).alias("all"))
    return entries.join(listed, F.col("game_id") == F.col("m_id"), "left").select(
        "game_id", "dat_id", "name", F.concat("name", F.lit("|"), F.coalesce("all", F.lit(""))).alias("identity")
    )


def combine_catalogs(entries: DataFrame, members: DataFrame) -> DataFrame:
    """One catalog of all: of entries with equal identity the one of the smallest catalog and id is kept."""
    known = entry_identity(entries, members)
    return known.groupBy(F.xxhash64("identity").alias("h"), F.sha2("identity", 256).alias("identity_sha256")).agg(
        F.min(F.struct("dat_id", "game_id", "name")).alias("kept"), F.count("*").alias("copies")
    ).select("kept.dat_id", "kept.game_id", "kept.name", "identity_sha256", "copies")


@dataclass(frozen=True)
class Filters:
    """What entries must be; unset options pass everything."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    no: tuple[str, ...] = ()
    only: tuple[str, ...] = ()
    only_retail: bool = False

    def __post_init__(self) -> None:
        both = set(self.no) & set(self.only)
        if both:
            raise ValueError(f"no- and only- exclude each other: {sorted(both)}")


def _attribute(which: str) -> Column:
    name, categories, maker = F.col("name"), F.col("category"), F.col("manufacturer")
    if which == "bios":
        return N.is_bios(F.col("isbios"), name)
    if which == "device":
        return F.coalesce(F.col("isdevice") == "yes", F.lit(False))
    if which == "unverified":
        return ~N.flag("verified", name)
    return N.flag(which, name, categories, maker)


def passes(filters: Filters) -> Column:
    """One conjunctive predicate of all filters."""
    name = F.col("name")
    tests = []
    if filters.include:
        tests.append(reduce(lambda a, b: a | b, [name.rlike(p) for p in filters.include]))
    tests += [~name.rlike(p) for p in filters.exclude]
    if filters.languages:
        tests.append(F.arrays_overlap(N.languages(name, F.col("release")), F.array(*[F.lit(x) for x in filters.languages])))
    if filters.regions:
        tests.append(F.arrays_overlap(N.regions(name, F.col("release")), F.array(*[F.lit(x) for x in filters.regions])))
    if filters.categories:
        tests.append(F.exists("category", lambda c: reduce(lambda a, b: a | b, [c.rlike(p) for p in filters.categories])))
    if filters.only_retail:
        tests.append(N.is_retail(name, F.col("category"), F.col("manufacturer")))
    tests += [~_attribute(w) for w in filters.no] + [_attribute(w) for w in filters.only]
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


def filter_entries(grouped: DataFrame, filters: Filters) -> DataFrame:
    """Entries that pass, each with ``parent_name``: that of its group, or the first left where the parent is gone."""
    kept = grouped.where(passes(filters))
    heads = kept.groupBy("dat_id", "group_name").agg(
        F.max((F.col("name") == F.col("group_name")).cast("int")).alias("alive"), F.min_by("name", "game_id").alias("first_name"))
    back = heads.select(F.col("dat_id").alias("h_dat"), F.col("group_name").alias("h_group"), F.when(F.col("alive") == 1, F.col("group_name")).otherwise(F.col("first_name")).alias("parent_name"))
    return kept.join(back, F.col("dat_id").eqNullSafe(F.col("h_dat")) & F.col("group_name").eqNullSafe(F.col("h_group"))).drop("h_dat", "h_group")


@dataclass(frozen=True)
class Preferences:
    """What makes one entry of a group the better; only what is set counts, in this order."""

    entry_patterns: tuple[str, ...] = ()
    member_patterns: tuple[str, ...] = ()
    verified: bool = False
    good: bool = False
    languages: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    revision: str | None = None
    retail: bool = False
    parent: bool = False
    order: tuple[str, ...] = field(default=("entry", "member", "verified", "good", "languages", "regions", "revision", "retail", "parent"), init=False)


def preference_key(p: Preferences) -> Column:
    """A struct that sorts the preferred entry first."""
    name, categories, maker = F.col("name"), F.col("category"), F.col("manufacturer")
    lacks = lambda listed, wanted: F.array(*[(~F.array_contains(listed, w)).cast("int") for w in wanted])
    keys: list[Column] = []
    if p.entry_patterns:
        keys.append((~reduce(lambda a, b: a | b, [name.rlike(x) for x in p.entry_patterns])).cast("int"))
    if p.member_patterns:
        keys.append((~F.coalesce(F.col("member_hit"), F.lit(False))).cast("int"))
    if p.verified:
        keys.append((~N.flag("verified", name)).cast("int"))
    if p.good:
        keys.append(N.flag("bad", name).cast("int"))
    if p.languages:
        keys.append(lacks(N.languages(name, F.col("release")), p.languages))
    if p.regions:
        keys.append(lacks(N.regions(name, F.col("release")), p.regions))
    if p.revision:
        rank = F.coalesce(N.revision(name), F.lit(0.0))
        keys.append(-rank if p.revision == "newer" else rank)
    if p.retail:
        keys.append((~N.is_retail(name, categories, maker)).cast("int"))
    if p.parent:
        keys.append((F.col("cloneof").isNotNull() | F.col("cloneofid").isNotNull()).cast("int"))
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col("game_id").alias("ord"))


def prefer(grouped: DataFrame, preferences: Preferences, members: DataFrame | None = None) -> DataFrame:
    """``dat_id, group_name, game_id, name, candidates``: the one entry preferred in each group.

    A minimum by the preference struct, combined before the shuffle: no group is sorted.
    """
    if preferences.member_patterns and members is not None:
        hit = reduce(lambda a, b: a | b, [F.col("name").rlike(x) for x in preferences.member_patterns])
        hits = members.groupBy(F.col("game_id").alias("h_id")).agg(F.bool_or(hit).alias("member_hit"))
        grouped = grouped.join(hits, F.col("game_id") == F.col("h_id"), "left")
    keyed = grouped.select("dat_id", "group_name", "game_id", "name", preference_key(preferences).alias("key"))
    return keyed.groupBy("dat_id", "group_name").agg(F.min_by(F.struct("game_id", "name"), "key").alias("best"), F.count("*").alias("candidates")).select(
        "dat_id", "group_name", "best.game_id", "best.name", "candidates"
    )


def sanitized(members: DataFrame) -> DataFrame:
    """Members that were dumped, one per name and kind in each entry, the first by place; all disks that were dumped."""
    dumped = members.where(~F.coalesce(F.col("status") == "nodump", F.lit(False)))
    key = ["game_id", "kind", "name"]
    others = [c for c in members.columns if c not in (*key, "ord", "rom_id")]
    first = dumped.where(F.col("kind") != "disk").groupBy(*key).agg(F.min(F.struct("ord", "rom_id", *others)).alias("m"))
    kept = first.select(*[F.col(c) if c in key else F.col(f"m.{c}").alias(c) for c in members.columns])
    return kept.unionByName(dumped.where(F.col("kind") == "disk"))


def romof_roots(entries: DataFrame) -> DataFrame:
    """``game_id, root_id``: the topmost ancestor by romof, where no link on the way is broken or circular."""
    named = entries.groupBy(F.col("dat_id").alias("p_dat"), F.col("name").alias("p_name")).agg(F.max("game_id").alias("parent"))
    links = entries.where(F.col("romof").isNotNull()).join(named, (F.col("dat_id") == F.col("p_dat")) & (F.col("romof") == F.col("p_name")), "left")
    known = links.where(F.col("parent").isNotNull()).select(F.lit("romof").alias("tree"), F.col("dat_id").alias("grp"), F.col("game_id").alias("child"), "parent")
    broken = links.where(F.col("parent").isNull()).select(F.col("game_id").alias("b_id"))
    done = climb(known).where(F.col("root") >= 0)
    return done.join(broken, F.col("root") == F.col("b_id"), "left_anti").select(F.col("node").alias("game_id"), F.col("root").alias("root_id"))


def _without(members: DataFrame, parents: DataFrame, above: DataFrame) -> DataFrame:
    """``members`` that their entry's parent (``above``: game_id, parent_id) lacks by name and identity."""
    last = parents.groupBy(F.col("game_id").alias("q_id"), F.col("kind").alias("q_kind"), F.col("name").alias("q_name")).agg(
        F.max_by("identity", F.struct("ord", "rom_id")).alias("q_identity"))
    held = above.select(F.col("game_id").alias("a_id"), "parent_id").join(last, F.col("parent_id") == F.col("q_id"))
    return members.join(
        held,
        (F.col("game_id") == F.col("a_id")) & (F.col("kind") == F.col("q_kind")) & (F.coalesce("merge", "name") == F.col("q_name")) & (F.col("identity") == F.col("q_identity")),
        "left_anti",
    )


def merge_split(entries: DataFrame, members: DataFrame, mode: str, devices: DataFrame | None = None) -> DataFrame:
    """``dat_id, game_id, rom_id, kind, name, identity``: the members of each set under a merge mode.

    ``fullnonmerged`` keeps all members and adds those of the devices an entry refers
    to (``devices``: game_id, device); ``nonmerged`` leaves out what the topmost romof
    ancestor holds (all of a BIOS, only BIOS members of another entry); ``split`` also
    what the parent holds; ``merged`` puts the clones' members into their parent under
    ``clone\\name`` and keeps each identity once, clones first; the
    disks that ``split`` leaves to entries that are no clones stay as they are.
    """
    rows = sanitized(members).select("dat_id", "game_id", "rom_id", "ord", "kind", "name", "identity", "merge", "bios")
    if mode == "fullnonmerged":
        if devices is not None:
            named = entries.select(F.col("dat_id").alias("v_dat"), F.col("name").alias("v_name"), F.col("game_id").alias("v_id"))
            uses = devices.select(F.col("game_id").alias("u_id"), "device").distinct().join(entries.select("game_id", "dat_id"), F.col("u_id") == F.col("game_id")).drop("game_id")
            uses = uses.join(named, (F.col("dat_id") == F.col("v_dat")) & (F.col("device") == F.col("v_name"))).select("u_id", "v_id")
            added = rows.join(uses, F.col("game_id") == F.col("v_id")).withColumn("game_id", F.col("u_id")).drop("u_id", "v_id")
            rows = rows.unionByName(added)
        return rows.select("dat_id", "game_id", "rom_id", "kind", "name", "identity")
    # Entries and members are used in several joins each, so both are made once.
    entries = written(entries.select(*[c for c in ("game_id", "dat_id", "id", "name", "cloneof", "cloneofid", "romof", "isbios") if c in entries.columns]))
    rows = sane = written(rows)
    roots = romof_roots(entries)
    bios = entries.select(F.col("game_id").alias("b_id"), N.is_bios(F.col("isbios"), F.col("name")).alias("b_is"))
    in_roots = rows.where(F.col("kind") != "disk").join(bios, F.col("game_id") == F.col("b_id")).where(F.col("b_is") | F.col("bios").isNotNull()).drop("b_id", "b_is")
    rows = _without(rows, in_roots, roots.select("game_id", F.col("root_id").alias("parent_id")))
    if mode in ("split", "merged"):
        named = entries.groupBy(F.col("dat_id").alias("p_dat"), F.col("name").alias("p_name")).agg(F.max("game_id").alias("parent_id"))
        above = entries.join(named, (F.col("dat_id") == F.col("p_dat")) & (F.col("cloneof") == F.col("p_name"))).select("game_id", "parent_id")
        rows = _without(rows, sane, above)
    if mode != "merged":
        return rows.select("dat_id", "game_id", "rom_id", "kind", "name", "identity")
    grouped = group_entries(entries).select(
        F.col("game_id").alias("g_id"), F.col("name").alias("g_name"), "group_name", (F.col("cloneof").isNotNull() | F.col("cloneofid").isNotNull()).alias("clone"))
    flat = rows.join(grouped, F.col("game_id") == F.col("g_id")).select(
        "dat_id", "group_name", "clone", "game_id", "ord", "rom_id", "kind", "identity", F.when(F.col("clone"), F.concat("g_name", F.lit("\\"), "name")).otherwise(F.col("name")).alias("name"))
    first = flat.where(F.col("kind") != "disk").groupBy("dat_id", "group_name", "identity").agg(
        F.min(F.struct((~F.col("clone")).alias("own"), "game_id", "ord", "rom_id", "kind", "name")).alias("m"))
    merged = first.select("dat_id", "group_name", "m.game_id", "m.rom_id", "m.kind", "m.name", "identity")
    disks = flat.where((F.col("kind") == "disk") & ~F.col("clone"))
    return merged.unionByName(disks.select(merged.columns))


def split_single_bios(entries: DataFrame, members: DataFrame, limit: int = 10) -> DataFrame:
    """``dat_id, game_id, rom_id, entry_name``: a catalog of one BIOS with many members as one entry per member."""
    alone = entries.groupBy("dat_id").agg(F.count("*").alias("n"), F.max("game_id").alias("only_id"), F.bool_and(N.is_bios(F.col("isbios"), F.col("name"))).alias("bios"))
    counted = members.groupBy(F.col("game_id").alias("c_id")).agg(F.count("*").alias("members"))
    wanted = alone.where((F.col("n") == 1) & F.col("bios")).join(counted, F.col("only_id") == F.col("c_id")).where(F.col("members") > limit)
    rows = members.join(wanted.select("only_id"), F.col("game_id") == F.col("only_id"))
    first = rows.groupBy("dat_id", "game_id", "identity").agg(F.min(F.struct("ord", "rom_id", "name")).alias("m"))
    return first.select("dat_id", "game_id", "m.rom_id", N.file_stem(F.col("m.name")).alias("entry_name"))
