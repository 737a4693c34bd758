"""Matching catalog members to scanned files: tiers, reasons, status, missing and unused."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.digests import MASK, member_identity, multiset_print, normal_digest, required_bit
from cartulary.functions.names import file_stem
from cartulary.operators.ranks import ranked
from cartulary.session import checkpointed

DIGESTS = ("crc32", "md5", "sha1", "sha256")
#: Containers in order of preference; a file outside any comes first.
CONTAINER_RANK = {"zip": 1, "tar": 2, "rar": 3, "7z": 4, "cso": 5, "gcz": 6, "rvz": 6, "wia": 6, "chd": 7}
ARCHIVE_PATTERN = r"(?i)\.(zip|zipx|tar|tgz|gz|rar|7z|z|cso|dax|zso|gcz|rvz|wia|chd)$"


def scanned_files(files: DataFrame) -> DataFrame:
    """Files once each, with normal digests, identity, container rank and place in scan order."""
    rows = files.select("file_id", "source", "relative", "size", *DIGESTS).distinct().withColumns({d: normal_digest(F.col(d), d) for d in DIGESTS})
    extension = F.lower(F.regexp_extract("relative", r"\.([A-Za-z0-9]+)$", 1))
    rank = F.when(~F.col("relative").rlike(ARCHIVE_PATTERN), 0)
    for name, place in CONTAINER_RANK.items():
        rank = rank.when(extension == name, place)
    return rows.withColumn("container", rank.otherwise(99)).withColumn("identity", member_identity(*[F.col(d) for d in DIGESTS], F.col("size")))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by order; combined before the shuffle, so hot keys are no burden."""
    others = [c for c in df.columns if c not in (key, order)]
    kept = df.groupBy(key).agg(F.min(F.struct(order, *others)).alias("kept"))
    return kept.select(key, F.col(f"kept.{order}").alias(order), *[F.col(f"kept.{c}").alias(c) for c in others])


def required_digests(members: DataFrame, least: str | None = None, most: str | None = None, patches: bool = False, inferred: bool = False) -> DataFrame:
    """``dat_id, mask``: bits of the digests that identify the members, raised to the least, cut to the most.

    Patches are found by CRC32, so they ask for it; a catalog made from files (``inferred``)
    lists CRC32, MD5 and SHA-1, whatever else is asked.
    """
    need = required_bit(*[F.col(d) for d in DIGESTS], F.col("size"))
    mask = F.bit_or(need)
    if least:
        mask = mask.bitwiseOR(MASK[least])
    if most:
        allowed = reduce(lambda a, b: a | b, [bit for bit in MASK.values() if bit <= MASK[most]])
        mask = mask.bitwiseAND(allowed)
    forced = (MASK["crc32"] if patches else 0) | (MASK["crc32"] | MASK["md5"] | MASK["sha1"] if inferred else 0)
    mask = mask.bitwiseOR(F.lit(forced)) if forced else mask
    return members.groupBy("dat_id").agg(mask.alias("mask")).withColumn("mask", F.when(F.col("mask") == 0, MASK["crc32"]).otherwise(F.col("mask")))


def tier_keys(df: DataFrame, *kept: str, suffix: str = "") -> DataFrame:
    """Long form ``tier, key`` of the digests a row has (columns with the ``suffix``), strongest first; a null never joins."""
    digest = {d: F.col(d + suffix) for d in DIGESTS}
    weak = F.concat(digest["crc32"], F.lit("|"), F.col("size" + suffix).cast("string"))
    keys = [(1, digest["sha256"]), (2, digest["sha1"]), (3, digest["md5"]), (4, weak)]
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), k.alias("key")) for t, k in keys])
    return df.select(*kept, F.inline(F.filter(tiers, lambda x: x["key"].isNotNull())))


#: Variants of a file in order of preference: as it is, without its header, padded.
RAW, HEADERLESS, PADDED = 0, 1, 2


def file_keys(files: DataFrame) -> DataFrame:
    """``variant, tier, key`` of files: of raw digests, of those behind a header (``*_headerless``) and of paddings, as far as the columns exist."""
    kept = ["file_id", "container", "source", "relative"]
    keys = tier_keys(files, *kept).withColumn("variant", F.lit(RAW))
    if "sha1_headerless" in files.columns:
        rows = files if "size_headerless" in files.columns else files.withColumn("size_headerless", F.lit(None).cast("bigint"))
        keys = keys.unionByName(tier_keys(rows, *kept, suffix="_headerless").withColumn("variant", F.lit(HEADERLESS)))
    if "paddings" in files.columns:
        padded = files.select(*kept, F.explode("paddings").alias("p")).select(*kept, F.col("p.padded_size").alias("size"), *[F.col(f"p.{d}").alias(d) for d in DIGESTS])
        keys = keys.unionByName(tier_keys(padded, *kept).withColumn("variant", F.lit(PADDED)))
    return keys


def variant_match(members: DataFrame, files: DataFrame) -> DataFrame:
    """``rom_id, file_id, tier, variant``: the file of each member, by the strongest digest that any variant of a file shares with it.

    Of one digest raw files come before headerless and padded variants.  Files of one
    key compete by variant, container, source and path, then id, before the join, so a
    digest shared by many files meets the members as one row; members of a hot digest are
    split by adaptive execution.  Members without a match are left out.
    """
    best = file_keys(files).groupBy("tier", "key").agg(F.min(F.struct("variant", "container", "source", "relative", "file_id")).alias("f"))
    keys = tier_keys(members, "rom_id")
    first = F.min(F.struct("tier", F.col("f.file_id").alias("file_id"), F.col("f.variant").alias("variant"))).alias("m")
    return keys.join(best, ["tier", "key"]).groupBy("rom_id").agg(first).select("rom_id", "m.file_id", "m.tier", "m.variant")


def tiered_match(members: DataFrame, files: DataFrame) -> DataFrame:
    """``rom_id, file_id, tier`` of ``variant_match``."""
    return variant_match(members, files).drop("variant")


def expected_outputs(matches: DataFrame, files: DataFrame) -> DataFrame:
    """``rom_id, size, crc32, md5, sha1, sha256``: what a written file must be, by the variant (of ``variant_match``) that was matched.

    A raw match is written as it is, a headerless one without its header.
    """
    known = files.select(F.col("file_id").alias("x_id"), *[F.col(c).alias(f"x_{c}") for c in ("size", *DIGESTS)], *[F.col(f"{c}_headerless").alias(f"h_{c}") for c in ("size", *DIGESTS)])
    met = matches.where(F.col("variant") != PADDED).join(known, F.col("file_id") == F.col("x_id"))
    return met.select("rom_id", *[F.when(F.col("variant") == HEADERLESS, F.col(f"h_{c}")).otherwise(F.col(f"x_{c}")).alias(c) for c in ("size", *DIGESTS)])


def deletable(moved: DataFrame, kept: DataFrame) -> DataFrame:
    """Moved inputs (``path``) that no output was written to (``path``)."""
    return moved.join(kept.select(F.col("path").alias("k")).distinct(), F.col("path") == F.col("k"), "left_anti")


def match_reasons(files: DataFrame, members: DataFrame) -> DataFrame:
    """``file_id, reasons``: every way a file meets any member: digests, checksum with size, size with name."""
    named = lambda df, path: df.select("*", F.concat(F.col("size").cast("string"), F.lit("|"), F.regexp_extract(path, r"([^/\\]*)$", 1)).alias("size_name"))
    weak = F.concat("crc32", F.lit("|"), F.col("size").cast("string"))

    def keys(df: DataFrame, *kept: str) -> DataFrame:
        ways = [("sha1", F.col("sha1")), ("sha256", F.col("sha256")), ("md5", F.col("md5")), ("crc32+size", weak), ("size+name", F.col("size_name"))]
        listed = F.array(*[F.struct(F.lit(w).alias("way"), k.alias("key")) for w, k in ways])
        return df.select(*kept, F.inline(F.filter(listed, lambda x: x["key"].isNotNull())))

    known = keys(named(members, F.col("name"))).distinct()
    met = keys(named(files, F.col("relative")), "file_id").join(known, ["way", "key"], "left_semi")
    return met.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("way")), ",").alias("reasons"))


def unmatched_files(files: DataFrame, members: DataFrame) -> DataFrame:
    """Files that meet no member in any way."""
    return files.join(match_reasons(files, members).select(F.col("file_id").alias("r_id")), F.col("file_id") == F.col("r_id"), "left_anti")


def entry_status(entries: DataFrame, members: DataFrame, matches: DataFrame) -> DataFrame:
    """``entries`` with ``members, found, status``: FOUND, INCOMPLETE or MISSING; an entry without members is found."""
    hit = members.join(matches.select(F.col("rom_id").alias("h_id")), F.col("rom_id") == F.col("h_id"), "left")
    per = hit.groupBy(F.col("game_id").alias("m_id")).agg(F.count("*").alias("members"), F.count("h_id").alias("found"))
    joined = entries.join(per, F.col("game_id") == F.col("m_id"), "left").drop("m_id").fillna(0, ["members", "found"])
    status = F.when(F.col("found") == F.col("members"), "FOUND").when(F.col("found") > 0, "INCOMPLETE").otherwise("MISSING")
    return joined.withColumn("status", status)


def fixdat(entries: DataFrame, members: DataFrame, matches: DataFrame) -> DataFrame:
    """Entries of which a member's identity is in no plan of the catalog; disks do not count."""
    planned = members.join(matches, "rom_id", "left_semi").select(F.col("dat_id").alias("p_dat"), F.col("identity").alias("p_identity")).distinct()
    lacking = members.where(F.col("kind") != "disk").join(planned, (F.col("dat_id") == F.col("p_dat")) & (F.col("identity") == F.col("p_identity")), "left_anti")
    return entries.join(lacking.select(F.col("game_id").alias("l_id")).distinct(), F.col("game_id") == F.col("l_id"), "left_semi")


def file_usage(files: DataFrame, matches: DataFrame) -> DataFrame:
    """``file_id, usage``: used by a match, duplicate of a used file, or unused."""
    used = files.join(matches.select(F.col("file_id").alias("u_id")).distinct(), F.col("file_id") == F.col("u_id"), "left")
    same = used.where(F.col("u_id").isNotNull()).select(F.col("identity").alias("s_identity")).distinct()
    joined = used.join(same, F.col("identity") == F.col("s_identity"), "left")
    usage = F.when(F.col("u_id").isNotNull(), "used").when(F.col("s_identity").isNotNull(), "duplicate").otherwise("unused")
    return joined.select("file_id", usage.alias("usage"))


def covering_archives(members: DataFrame, files: DataFrame) -> DataFrame:
    """``game_id, archive``: folders that hold exactly the members of an entry, by fingerprints of both (relational division)."""
    want = members.where(F.col("kind") != "disk").groupBy("game_id").agg(multiset_print(F.col("identity")).alias("all"))
    folder = F.regexp_extract("relative", r"^(.*)/[^/]*$", 1)
    have = files.where(folder != "").groupBy(F.concat("source", F.lit("/"), folder).alias("archive")).agg(multiset_print(F.col("identity")).alias("all"))
    return want.join(have, "all").select("game_id", "archive")


def enrich_digests(files: DataFrame) -> DataFrame:
    """``file_id`` with digests that other files of equal digests know: by crc32 with size, then md5, sha1, sha256; the last file wins.

    Each round is an aggregation by one of the digests that the files came with and a
    join back; digests shared by few files stay small, a hot one is one row of the aggregate.
    """
    own = files.select("file_id", *DIGESTS, *[F.col(d).alias(f"by_{d}") for d in DIGESTS if d != "crc32"], F.when(F.col("size") > 0, F.concat("crc32", F.lit("|"), F.col("size").cast("string"))).alias("by_crc32"))
    rows, keys = own, [f"by_{d}" for d in DIGESTS]
    for by in keys:
        known = own.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("by")).agg(
            *[F.max_by(d, F.when(F.col(d).isNotNull(), F.col("file_id"))).alias(f"k_{d}") for d in DIGESTS])
        rows = rows.join(known, F.col(by) == F.col("by"), "left").select("file_id", *keys, *[F.coalesce(f"k_{d}", d).alias(d) for d in DIGESTS])
    return rows.select("file_id", *DIGESTS)


def fill_from_cache(files: DataFrame, cache: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``files`` with null ``columns`` filled from a cache of the same ``path, size, mtime``; other versions do not count."""
    key = ["path", "size", "mtime"]
    known = cache.dropDuplicates(key).select(*[F.col(k).alias(f"c_{k}") for k in key], *[F.col(c).alias(f"c_{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"c_{k}") for k in key])
    filled = files.join(known, same, "left")
    return filled.select(*[F.coalesce(c, f"c_{c}").alias(c) if c in columns else F.col(c) for c in files.columns])


def inherit_genres(entries: DataFrame) -> DataFrame:
    """``game_id, genre, inherited``: an entry without genre takes that of the entry it is a clone of."""
    parents = entries.groupBy(F.col("dat_id").alias("p_dat"), F.col("name").alias("p_name")).agg(F.min_by("genre", "game_id").alias("p_genre"))
    joined = entries.join(parents, (F.col("dat_id") == F.col("p_dat")) & (F.col("cloneof") == F.col("p_name")), "left")
    own = F.nullif("genre", F.lit(""))
    return joined.select("game_id", F.coalesce(own, "p_genre").alias("genre"), (own.isNull() & F.col("p_genre").isNotNull()).alias("inherited"))


#: Scores of what a file and a member share.
SCORES = {"sha1": 900.0, "md5": 850.0, "crc32": 800.0, "size_name": 700.0, "size": 20.0, "title": 300.0}
LEAST_SCORE = 25.0


def _parts(df: DataFrame, key: str, name: str, place: Column) -> DataFrame:
    """``id, place, size, digests, base, title``: what the score of a member or file is made of."""
    title = F.lower(F.trim(F.regexp_replace(F.regexp_replace(file_stem(F.col(name)), r"\([^()]*\)|\[[^\[\]]*\]", ""), r"\s+", " ")))
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return df.select(F.col(key).alias("id"), place.alias("place"), "size", "crc32", "md5", "sha1", base.alias("base"), F.coalesce(title, F.lit("")).alias("title"))


def _words(title: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(title, r"[^\p{L}\p{N}]+"), lambda w: w != "")))


def _jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)) * SCORES["title"]


def _profile() -> Column:
    """One number for files of which no score can differ (64 bits; two among n agree by chance once in 2**65 / n**2)."""
    return F.xxhash64(F.lit("profile"), *[F.coalesce(c, F.lit("")) for c in ("sha1", "md5", "crc32", "base", "title")], F.coalesce("size", F.lit(-1)))


def _name_keys() -> list[tuple[Column, float | Column]]:
    """Keys by which names and titles agree, with the score of two that share one; null where one can't be had."""
    sized = F.col("size").isNotNull()
    titled = F.col("title") != ""
    both = SCORES["size_name"] + F.when(titled, SCORES["title"]).otherwise(0.0)
    return [
        (F.when(sized & (F.col("base") != ""), F.xxhash64(F.lit("name"), "base", "size")), both),
        (F.when(sized & titled, F.xxhash64(F.lit("title+size"), "title", "size")), F.lit(SCORES["title"] + SCORES["size"])),
        (F.when(titled, F.xxhash64(F.lit("title"), "title")), F.lit(SCORES["title"])),
    ]


def _digest_asks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Asks of the members that share a digest with files: each profile of such files, with its score."""

    def ways(df: DataFrame, key: Column, name: str) -> DataFrame:
        keys = [F.xxhash64(F.lit(d), d) for d in ("sha1", "md5")] + [F.xxhash64(F.lit("crc32"), "crc32", "size")]
        known = [F.col("sha1").isNotNull(), F.col("md5").isNotNull(), F.col("crc32").isNotNull() & F.col("size").isNotNull()]
        listed = F.array(*[F.when(k, v) for k, v in zip(known, keys)])
        return df.select(key.alias(name), F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("way"))

    profiles = right.select(_profile().alias("key"), *[c for c in right.columns if c not in ("id", "place")]).dropDuplicates(["key"])
    pairs = ways(left, F.col("id"), "rom_id").join(ways(right, _profile(), "key"), "way").select("rom_id", "key").distinct()
    l, f = (df.select(k, F.struct("size", "crc32", "md5", "sha1", "base", "title").alias(n)) for df, k, n in ((left, F.col("id").alias("rom_id"), "l"), (profiles, F.col("key"), "f")))
    met = pairs.join(l, "rom_id").join(f, "key")
    same = lambda c: F.coalesce(F.col(f"l.{c}") == F.col(f"f.{c}"), F.lit(False))
    score = (
        F.when(same("sha1"), SCORES["sha1"]).otherwise(0.0) + F.when(same("md5"), SCORES["md5"]).otherwise(0.0) + F.when(same("crc32") & same("size"), SCORES["crc32"]).otherwise(0.0)
        + F.when(same("size") & same("base"), SCORES["size_name"]).when(same("size"), SCORES["size"]).otherwise(0.0)
        + F.when((F.col("l.title") != "") & same("title"), SCORES["title"]).otherwise(_jaccard(_words(F.col("l.title")), _words(F.col("f.title"))))
    )
    return met.select("rom_id", "key", score.alias("base"), *_no_words(), F.lit(True).alias("by_digest"))


def _no_words() -> list[Column]:
    return [F.lit(0).cast("byte").alias(c) for c in ("shared", "words")]


#: Titles of more words than this are compared in pairs; of the others all sets of words are keys (63 of six words).
LONG = 6


def _keys(df: DataFrame, name: str, *kept: str, profile: bool = False) -> DataFrame:
    """``df`` once for each key by name, title or set of title words: ``key, base, shared, words``."""
    plain = [(_profile(), F.lit(0.0))] * profile + [(k, F.lit(s) if isinstance(s, float) else s) for k, s in _name_keys()]
    named = F.array(*[F.struct(k.alias("key"), s.alias("base"), *_no_words()) for k, s in plain])
    n = F.size("w").cast("byte").alias("words")

    def of(s: Column) -> Column:
        size = F.size(s).cast("byte").alias("shared")
        alone = F.struct(F.xxhash64(F.lit("words"), s).alias("key"), F.lit(0.0).alias("base"), size, n)
        sized = F.struct(F.when(F.col("size").isNotNull(), F.xxhash64(F.lit("words+size"), s, "size")).alias("key"), F.lit(SCORES["size"]).alias("base"), size, n)
        return F.array(alone, sized)

    none = F.array().cast("array<array<bigint>>")
    sets = F.aggregate(F.transform("w", lambda w: F.xxhash64(w)), none, lambda acc, w: F.concat(acc, F.array(F.array(w)), F.transform(acc, lambda s: F.concat(s, F.array(w)))))
    few = F.when(F.size("w").between(1, LONG), sets).otherwise(none)
    listed = F.filter(F.concat(named, F.flatten(F.transform(few, of))), lambda x: x["key"].isNotNull())
    return df.withColumn("w", _words(F.col("title"))).select(F.col("id").alias(name), *kept, F.inline(listed))


def _asks(left: DataFrame, right: DataFrame) -> DataFrame:
    """``rom_id, key, base, shared, words, by_digest``: the keys under which a member finds files, with the score of each."""
    by_digest = _digest_asks(left, right)
    rest = left.join(by_digest.select(F.col("rom_id").alias("d_id")).distinct(), F.col("id") == F.col("d_id"), "left_anti")
    return by_digest.unionByName(_keys(rest, "rom_id").withColumn("by_digest", F.lit(False))).unionByName(_long_asks(rest, right))


def _listed(df: DataFrame, name: str, *rows: Column) -> DataFrame:
    return df.select(F.col("id").alias(name), F.inline(F.filter(F.array(*rows), lambda x: x["key"].isNotNull())))


def _long_asks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Asks of members for files by title where either title is long: distinct titles that share a word, in pairs."""
    titles = lambda df: df.select("title").distinct().select("title", _words(F.col("title")).alias("w"))
    spread = lambda df, s: df.select(F.struct("title", "w").alias(s), F.explode("w").alias("word"))
    mine, theirs, long = titles(left), titles(right), F.size("w") > LONG
    met = spread(mine.where(long), "l").join(spread(theirs, "f"), "word").unionByName(spread(mine.where(~long), "l").join(spread(theirs.where(long), "f"), "word"))
    pairs = met.select("l", "f").distinct().where(F.col("l.title") != F.col("f.title")).select(F.col("l.title").alias("l_title"), F.col("f.title").alias("title"), _jaccard(F.col("l.w"), F.col("f.w")).alias("score"))
    pairs = pairs.where(F.col("score") + SCORES["size"] >= LEAST_SCORE)
    rows = left.select("id", "size", F.col("title").alias("own")).join(pairs, F.col("own") == F.col("l_title"))
    (_, _), (sized, _), (titled, _) = _name_keys()
    asks = [F.struct(k.alias("key"), s.alias("base"), *_no_words(), F.lit(False).alias("by_digest")) for k, s in ((sized, F.col("score") + SCORES["size"]), (titled, F.col("score")))]
    return _listed(rows, "rom_id", *asks)


def _supply(right: DataFrame) -> DataFrame:
    """``place, key, words``: the files under each key; those with fewer words come first, then by place."""
    return _keys(right, "file_id", "place", profile=True).select("place", "key", "words")


def _sides(members: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What scores need of members and of files, written once, and ``file_id, place``: the files' order by path."""
    path = F.coalesce(F.concat("source", F.lit("::"), "relative"), F.lit(""))
    placed = ranked(files.withColumn("path", path), [], ["path", "file_id"])
    right = checkpointed(_parts(placed, "file_id", "relative", F.col("rank")))
    return checkpointed(_parts(members, "rom_id", "name", F.lit(0))), right, right.select(F.col("id").alias("file_id"), "place")


def fuzzy_match(members: DataFrame, files: DataFrame) -> DataFrame:
    """``rom_id, file_id, score, by_digest``: the best file of each member by digests, size, name and title words.

    Members ask under keys, and of each key only the first file can be the best one,
    so a member meets one file per key it has.  Titles that agree in part meet under
    the words they share: every set of a title's words is a key, and of the files with
    these words the one with the fewest words is the most alike.  Only long titles are
    compared in pairs, and members with the profiles of files that share a digest.
    Files that agree by digest displace all others; then score, then path.
    """
    left, right, places = _sides(members, files)
    first = _supply(right).groupBy("key").agg(F.min(F.struct("words", "place")).alias("f"))
    score = F.col("base") + F.when(F.col("shared") > 0, F.col("shared") / (F.col("words") + F.col("f.words") - F.col("shared")) * SCORES["title"]).otherwise(0.0)
    scored = _asks(left, right).join(first, "key").select("rom_id", F.col("f.place").alias("place"), score.alias("score"), "by_digest")
    won = scored.where(F.col("score") >= LEAST_SCORE).groupBy("rom_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "place", "by_digest")).alias("m"))
    return won.select("rom_id", "m.place", F.round(-F.col("m.s"), 6).alias("score"), "m.by_digest").join(places, "place").select("rom_id", "file_id", "score", "by_digest")


def fuzzy_assign(members: DataFrame, files: DataFrame) -> DataFrame:
    """``rom_id, file_id``: each file for one member at most, of all files that score for a member.

    Greedy by descending score, then smaller ``rom_id``, then path: a member whose best
    files are taken goes on to its next one, until its list ends.
    """
    left, right, places = _sides(members, files)
    return _dealt(_asks(left, right), _supply(right), LEAST_SCORE).join(places, "place").select("rom_id", "file_id")


def assign_once(scored: DataFrame) -> DataFrame:
    """Each file for one member at most, by descending score, then smaller ids, until no pair of ``scored`` (``rom_id, file_id, score``) is left."""
    asks = scored.select("rom_id", F.col("file_id").cast("long").alias("key"), F.col("score").cast("double").alias("base"), *_no_words())
    supply = scored.select(F.col("file_id").cast("long").alias("key")).distinct().select("key", F.col("key").alias("place"), _no_words()[1])
    return _dealt(asks, supply).select("rom_id", F.col("place").alias("file_id"))


def _dealt(asks: DataFrame, supply: DataFrame, least: float = float("-inf")) -> DataFrame:
    """``rom_id, place``: greedy assignment in one task, as each choice depends on all before it.

    ``asks``: ``rom_id, key, base, shared, words``; ``supply``: ``key, place, words``.
    Pairs below the ``least`` score do not count.
    """
    long, byte, none = (lambda c: F.col(c).cast("long")), (lambda c: F.col(c).cast("byte")), F.lit(0)
    told = asks.select(F.lit(True).alias("ask"), "key", long("rom_id").alias("id"), "base", byte("shared").alias("shared"), byte("words").alias("words"))
    held = supply.select(F.lit(False).alias("ask"), "key", long("place").alias("id"), none.cast("double").alias("base"), none.cast("byte").alias("shared"), byte("words").alias("words"))
    return told.unionByName(held).repartition(1).mapInArrow(partial(_deal, least), "rom_id long, place long")


def _deal(least: float, batches):
    """The sequence of the greedy assignment: a queue of members by their best score, and a pointer to the next free file of each key."""
    import heapq

    import numpy as np
    import pyarrow as pa

    columns: list[list] = [[] for _ in range(6)]
    for batch in batches:
        for held, column in zip(columns, batch.columns):
            held.append(column.to_numpy(zero_copy_only=False))
    if not columns[0]:
        return
    ask = np.concatenate(columns[0]).astype(bool)
    key, ids, base, shared, words = (np.concatenate(c) for c in columns[1:])
    del columns
    s_key, s_place, s_words = key[~ask], ids[~ask], words[~ask]
    order = np.lexsort((s_place, s_words, s_key))
    s_key, s_place, s_words = s_key[order], s_place[order], s_words[order]
    keys, starts = np.unique(s_key, return_index=True)
    places, entry = np.unique(s_place, return_inverse=True)
    ends = np.append(starts[1:], len(s_key))
    key, ids, base, shared, words = key[ask], ids[ask], base[ask], shared[ask], words[ask]
    slot = np.searchsorted(keys, key)
    known = (slot < len(keys)) & (keys[np.minimum(slot, len(keys) - 1)] == key) if len(keys) else np.zeros(len(key), bool)
    ids, base, shared, words, slot = ids[known], base[known], shared[known], words[known], slot[known]
    order = np.argsort(ids, kind="stable")
    base, shared, words, slot = (memoryview(np.ascontiguousarray(c[order])) for c in (base, shared, words, slot))
    roms, first = np.unique(ids[order], return_index=True)
    first = np.append(first, len(order)).tolist()
    next_, end, entry, s_words = memoryview(starts.copy()), memoryview(ends), memoryview(np.ascontiguousarray(entry)), memoryview(np.ascontiguousarray(s_words))
    used, scale = bytearray(len(places)), SCORES["title"]

    def best(rom: int) -> tuple[float, int]:
        top, file = float("-inf"), -1
        for i in range(first[rom], first[rom + 1]):
            at = slot[i]
            p, stop = next_[at], end[at]
            while p < stop and used[entry[p]]:
                p += 1
            next_[at] = p
            if p == stop:
                continue
            n = shared[i]
            score = base[i] + n / (words[i] + s_words[p] - n) * scale if n else base[i]
            if file < 0 or score > top or score == top and entry[p] < file:
                top, file = score, entry[p]
        return top, file

    queue = [(-score, rom) for rom in range(len(roms)) for score, file in [best(rom)] if file >= 0 and score >= least]
    heapq.heapify(queue)
    taken: list[tuple[int, int]] = []
    while queue:
        was, rom = heapq.heappop(queue)
        score, file = best(rom)
        if file < 0:
            continue
        if score == -was:
            used[file] = 1
            taken.append((rom, file))
        elif score >= least:
            heapq.heappush(queue, (-score, rom))
    pairs = np.array(taken, dtype=np.int64).reshape(-1, 2)
    for i in range(0, len(pairs), 50_000):
        part = pairs[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(roms[part[:, 0]]), pa.array(places[part[:, 1]])], names=["rom_id", "place"])


def patch_candidates(matched: DataFrame, patches: DataFrame) -> DataFrame:
    """``matched`` (``rom_id, crc32, name``) and, for each patch of an input's CRC, a patched row besides the original.

    ``patches``: ``path, crc_before, crc_after, size_after``.  A patch without its own
    CRC takes the eight hexadecimal digits of its file name.
    """
    named = F.lower(F.regexp_extract("path", r"(?:^|[^a-fA-F0-9])([a-fA-F0-9]{8})(?:[^a-fA-F0-9]|$)", 1))
    before = F.coalesce(F.lower("crc_before"), F.nullif(named, F.lit("")))
    known = patches.select("path", before.alias("before"), "crc_after", "size_after").where(F.col("before").isNotNull())
    stem = file_stem(F.col("path"))
    name = F.concat(stem, F.regexp_extract("name", r"(\.[^./\\]*)$", 1))
    patched = matched.join(known, F.lower("crc32") == F.col("before")).select(
        "rom_id", F.col("crc_after").alias("crc32"), name.alias("name"), F.lit(True).alias("patched"), F.col("path").alias("patch"))
    return matched.select("rom_id", "crc32", "name", F.lit(False).alias("patched"), F.lit(None).cast("string").alias("patch")).unionByName(patched)


def assign_by_prefix(files: DataFrame, prefixes: DataFrame, default: str = "") -> DataFrame:
    """``file_id, label``: a row for every prefix (of ``prefix, label``) that a file's ``path`` starts with, the default label without any.

    Prefixes are plain beginnings, not whole folders, and may overlap: a file counts
    under each.  Paths are cut at the lengths that prefixes have, which are no more than
    a path is long, and joined by equality, so prefixes are never crossed with files.
    """
    lengths = sorted(r["n"] for r in prefixes.where(F.col("prefix").isNotNull()).select(F.length("prefix").alias("n")).distinct().collect())
    if not lengths:
        return files.select("file_id", F.lit(default).alias("label"))
    heads = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda h: h.isNotNull())
    known = prefixes.select(F.col("prefix").alias("head"), "label").distinct()
    under = files.select("file_id", F.explode(heads).alias("head")).join(known, "head").select(F.col("file_id").alias("u_id"), "label").distinct()
    return files.select("file_id").join(under, F.col("file_id") == F.col("u_id"), "left").select("file_id", F.coalesce("label", F.lit(default)).alias("label"))


def consumed_archives(files: DataFrame, moved: DataFrame) -> DataFrame:
    """Folders all of whose files were moved."""
    archive = F.concat("source", F.lit("/"), F.regexp_extract("relative", r"^(?:(.*)/)?[^/]*$", 1)).alias("archive")
    left = files.join(moved.select(F.col("file_id").alias("m_id")), F.col("file_id") == F.col("m_id"), "left")
    return left.groupBy(archive).agg(F.count("*").alias("files"), F.count("m_id").alias("moved")).where(F.col("files") == F.col("moved"))


def member_archives(members: DataFrame) -> DataFrame:
    """``dat_id, archives``: whether any member of a catalog is an archive by its name."""
    return members.groupBy("dat_id").agg(F.bool_or(F.col("name").rlike(ARCHIVE_PATTERN)).alias("archives"))


def json_fields(df: DataFrame, key: str, text: str, paths: dict[str, str]) -> DataFrame:
    """Scalar fields of a JSON column by path; null where text or path is missing or invalid."""
    return df.select(key, *[F.get_json_object(text, p).alias(n) for n, p in paths.items()])
