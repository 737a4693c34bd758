"""Variants of scanned files: titles, choice of one variant per title, reasons for the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import names as N


def described(files: DataFrame) -> DataFrame:
    """``file_id, relative, title, region, languages, quality, rank, set_number`` read off each file's name."""
    stem = N.file_stem(F.col("relative"))
    rows = files.select("file_id", "relative").distinct().withColumn("stem", stem).withColumn("listed", N.tags(F.col("stem")))
    at = (F.col("stem"), F.col("listed"))
    title = N.bare_title(F.col("stem"))
    return rows.select(
        "file_id", "relative", F.when(title == "", F.col("stem")).otherwise(title).alias("title"),
        N.tag_region(*at).alias("region"), N.tag_languages(*at).alias("languages"), N.tag_quality(*at).alias("quality"), N.tag_revision(*at).alias("rank"),
        N.set_number(*at).alias("set_number"))


def _place(value: Column, wanted: tuple[str, ...]) -> Column:
    found = F.array_position(F.array(*[F.lit(w) for w in wanted]), value) if wanted else F.lit(0)
    return F.when(F.coalesce(found, F.lit(0)) > 0, found - 1).otherwise(len(wanted))


def choose_variants(rows: DataFrame, regions: tuple[str, ...] = (), languages: tuple[str, ...] = ()) -> DataFrame:
    """``file_id, title, kept, reason``: the first acceptable variant of each title, and why the others were skipped.

    Acceptable is a preferred region or language.  Variants rank by region, language,
    quality, revision, set and path; the best is a minimum combined before the shuffle
    and joined back by title.
    """
    language_rank = F.array_min(F.transform(F.when(F.size("languages") > 0, F.col("languages")).otherwise(F.array(F.lit(""))), lambda x: _place(x, languages)))
    quality = F.array_position(F.array(*[F.lit(q) for q in N.QUALITY_TIERS]), F.col("quality"))
    ranked = rows.withColumn("r", _place(F.col("region"), regions)).withColumn("l", language_rank)
    fits = (F.col("r") < len(regions)) if regions else F.lit(False)
    speaks = (F.col("l") < len(languages)) if languages else F.lit(False)
    ranked = ranked.withColumn("fits", (fits | speaks) if regions or languages else F.lit(True)).withColumn(
        "key", F.struct("r", "l", quality.alias("q"), "rank", F.col("set_number").isNull().alias("none"), "set_number", "relative", "file_id"))
    best = ranked.where("fits").groupBy(F.col("title").alias("b_title")).agg(F.min("key").alias("b"))
    joined = ranked.join(best, F.col("title") == F.col("b_title"), "left")
    kept = F.coalesce(F.col("key") == F.col("b"), F.lit(False))
    why = (
        F.when(kept, F.lit(None)).when(~F.col("fits"), "not in preferences").when(F.col("r") > F.col("b.r"), "region").when(F.col("l") > F.col("b.l"), "language")
        .when(F.col("key.q") > F.col("b.q"), "quality").when(F.col("rank") > F.col("b.rank"), "revision").otherwise("another variant")
    )
    return joined.select("file_id", "title", kept.alias("kept"), why.alias("reason"))


def pattern_reasons(rows: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (``file_id, relative``) with ``reason``: why patterns leave a file out; null if they do not."""
    hit = lambda patterns: F.coalesce(F.col("relative").rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))
    reason = F.lit(None).cast("string")
    if exclude:
        reason = F.when(hit(exclude), "excluded").otherwise(reason)
    if include:
        reason = F.when(~hit(include), "not included").otherwise(reason)
    return rows.select("file_id", reason.alias("reason"))


def skip_breakdown(chosen: DataFrame) -> DataFrame:
    """Skipped variants counted by reason."""
    return chosen.where(~F.col("kept")).groupBy("reason").agg(F.count("*").alias("files"))


def localized(files: DataFrame) -> DataFrame:
    """``file_id, region, languages``: what a record lacks is filled from the tags of its name."""
    stem = N.file_stem(F.col("relative"))
    own = F.nullif(F.trim("derived_region"), F.lit(""))
    said = F.nullif(F.trim("derived_languages"), F.lit(""))
    return files.select("file_id", "relative", "derived_region", "derived_languages").distinct().select(
        "file_id", F.coalesce(own, N.tag_region(stem)).alias("region"), F.coalesce(said, F.nullif(F.array_join(N.tag_languages(stem), ","), F.lit(""))).alias("languages")
    )


def assign_platforms(catalogs: DataFrame, platforms: DataFrame, block: int = 500) -> DataFrame:
    """``catalogs`` (``name, extension``) with ``platform``: the last pattern the name matches, else the first platform of the extension.

    ``platforms``: ``ord, platform, pattern, extensions array<string>``.  The table is
    a list of patterns, which only expressions can test: they are taken in blocks of
    bounded size, one step of the plan for each, so catalogs are neither shuffled nor
    crossed with it, and no pattern is left out.
    """
    rows = [r for r in platforms.orderBy("ord").toLocalIterator()]
    named = catalogs.withColumn("platform", F.lit(None).cast("string"))
    for lo in range(0, len(rows), block):
        by_name = F.col("platform")
        for r in rows[lo : lo + block]:
            if r["pattern"]:
                by_name = F.when(F.col("name").rlike(r["pattern"]), r["platform"]).otherwise(by_name)
        named = named.withColumn("platform", by_name)
    first: dict[str, str] = {}
    for r in rows:
        for extension in r["extensions"] or []:
            first.setdefault(extension.lower(), r["platform"])
    pairs = list(first.items())
    for lo in range(0, len(pairs), block):
        known = F.create_map(*[F.lit(x) for pair in pairs[lo : lo + block] for x in pair])
        named = named.withColumn("platform", F.coalesce("platform", F.try_element_at(known, F.lower("extension"))))
    return named


def digests_in_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, sha1, md5``: the first hexadecimal runs of 40 and 32 digits anywhere in a JSON text."""
    run = lambda n: F.nullif(F.lower(F.regexp_extract(text, rf"(?<![0-9a-fA-F])([0-9a-fA-F]{{{n}}})(?![0-9a-fA-F])", 1)), F.lit(""))
    return df.select(key, run(40).alias("sha1"), run(32).alias("md5"))
