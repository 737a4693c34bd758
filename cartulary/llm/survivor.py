"""Best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import is_given, strip

#: Qualities from least to most trusted; anything else counts as none given.
QUALITY_ORDER = ("bad", "modified", "clean", "pending", "fixed", "verified")
FIELDS = ("region", "languages", "quality", "revision")

#: Votes: weight of a source grows by this factor with each step of trust and halves with this age in days;
#: times are counted from a fixed day (2020-01-01, as days since 1970), beyond so many half-lives either way all alike.
TRUST_FACTOR = 3
HALF_LIFE_DAYS = 180
ORIGIN_DAY, HALF_LIVES = 18_262, 20


def _plain(col: Column) -> Column:
    return F.lower(strip(col))


def quality_rank(plain: Column) -> Column:
    """0 for none given up to 6 for verified, of a plain quality."""
    ranks = F.create_map(*[F.lit(x) for i, name in enumerate(QUALITY_ORDER, start=1) for x in (name, i)])
    return F.coalesce(F.try_element_at(ranks, plain), F.lit(0))


def given_languages(languages: Column) -> Column:
    """The different languages that are given, case and outer blanks aside, in order."""
    plain = F.array_distinct(F.transform(F.coalesce(languages, F.array().cast("array<string>")), _plain))
    return F.array_sort(F.filter(plain, lambda x: is_given(x, plain=True)))


#: A revision: its word and its number or letters, brackets aside.
_REVISION = r"^\(?\s*(prg|v|ver|version|rev|revision)[\s._-]*(\d+(?:\.\d+)*|[a-z]+)\s*\)?$"


def revision_key(word: Column, mark: Column) -> Column:
    """``struct(kind, numbers)`` in the order of revisions: PRG, version, numbered Rev, lettered Rev, others.

    Numbers compare one by one and absent ones are 0; letters compare by length, then alphabet.
    """
    numbered = mark.rlike("^[0-9]")
    kind = (
        F.when(word == "", 0).when(word.startswith("prg") & numbered, 4).when(word.startswith("v") & numbered, 3)
        .when(word.startswith("rev") & numbered, 2).when(word.startswith("rev"), 1).otherwise(0)
    )
    trimmed = F.regexp_replace(mark, r"(?:\.0+)+$", "")
    numbers = F.transform(F.split(trimmed, r"\."), lambda n: F.coalesce(n.try_cast("bigint"), F.lit((1 << 63) - 1)))
    codes = F.concat(F.array(F.length(mark).cast("bigint")), F.transform(F.split(mark, ""), lambda c: F.ascii(c).cast("bigint")))
    none = F.array().cast("array<bigint>")
    return F.struct(kind.alias("kind"), F.when(kind >= 2, numbers).when(kind == 1, codes).otherwise(none).alias("numbers"))


def vote(rank: Column, at: Column) -> Column:
    """Source trust times recency decay, as a whole number, so that sums do not depend on their order.

    Trust is ``TRUST_FACTOR`` to the power of the quality's rank.  The decay doubles
    from half-life to half-life towards later times and is linear between; a null time
    counts as the earliest.
    """
    days = F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(86_400e6)) - ORIGIN_DAY
    span = HALF_LIVES * HALF_LIFE_DAYS
    age = F.coalesce(F.least(F.greatest(days, F.lit(-span)), F.lit(span)), F.lit(-span)) + span
    decay = F.pow(F.lit(2.0), F.floor(age / HALF_LIFE_DAYS)).cast("bigint") * (HALF_LIFE_DAYS + age % HALF_LIFE_DAYS)
    return (F.pow(F.lit(float(TRUST_FACTOR)), rank).cast("bigint") * decay).cast("decimal(19,0)")


def long_votes(candidates: DataFrame) -> DataFrame:
    """One row per record and field: ``title, field, value, cand_id, weight, standing``.

    ``value`` is the normalised value, ``weight`` the record's vote, and ``standing``
    ranks the record for the field, best greatest: what ranks a value before trust does
    (number of languages, revision), then the record's quality, time and id.  Value and
    standing are null where none is given.
    """
    none = F.lit(None).cast("array<bigint>")
    # Plain fields first, so that each is stripped and matched once however often it is used below.
    plain = candidates.where(F.col("title").isNotNull() & F.col("cand_id").isNotNull()).select(
        "title", "cand_id", "updated_at", _plain(F.col("region")).alias("region"), given_languages(F.col("languages")).alias("languages"),
        _plain(F.col("quality")).alias("quality"), _plain(F.col("revision")).alias("revision"))
    plain = plain.select(
        "*", quality_rank(F.col("quality")).alias("rank"), F.coalesce(F.regexp_extract("revision", _REVISION, 1), F.lit("")).alias("word"),
        F.coalesce(F.regexp_extract("revision", _REVISION, 2), F.lit("")).alias("mark"))
    plain = plain.withColumn("order", revision_key(F.col("word"), F.col("mark")))

    def field(name: str, value: Column, given: Column, kind: Column, numbers: Column) -> Column:
        return F.struct(
            F.lit(name).alias("field"), F.when(given, value).alias("value"), given.alias("given"),
            kind.cast("int").alias("kind"), numbers.alias("numbers"))

    fields = F.array(
        field("region", F.col("region"), is_given(F.col("region"), plain=True), F.lit(0), none),
        field("languages", F.array_join("languages", ","), F.size("languages") > 0, F.size("languages"), none),
        field("quality", F.col("quality"), is_given(F.col("quality"), plain=True), F.lit(0), none),
        field("revision", F.col("revision"), is_given(F.col("revision"), plain=True), F.col("order.kind"), F.col("order.numbers")),
    )
    rows = plain.select("title", "cand_id", "rank", "updated_at", vote(F.col("rank"), F.col("updated_at")).alias("weight"), F.inline(fields))
    order = F.struct("kind", "numbers", F.col("rank").alias("quality"), F.col("updated_at").alias("at"), (-F.col("cand_id")).alias("id"))
    return rows.select("title", "field", "value", "cand_id", "weight", F.when(F.col("given"), order).alias("standing"))


def _elected(candidates: DataFrame, votes: str) -> DataFrame:
    """One row per title: for each field a struct ``value, cand_id, score`` of the winner, null where no record gives one."""
    per_value = long_votes(candidates).groupBy("title", "field", "value").agg(
        F.max("standing").alias("best"), F.sum("weight").alias("votes"), F.min("cand_id").alias("least"), F.max("cand_id").alias("most"))
    key = F.struct("votes", "best") if votes == "sum" else F.struct("best", "votes")
    winner = F.struct("value", (-F.col("best.id")).alias("cand_id"), F.col("votes").alias("score"))
    wins = lambda f: F.max_by(winner, F.when((F.col("field") == f) & F.col("best").isNotNull(), key))
    record = per_value.groupBy("title").agg(*[wins(f).alias(f) for f in FIELDS], F.min("least").alias("least"), F.max("most").alias("most"))
    some = [F.col(f).isNotNull() for f in FIELDS]
    return record.where((F.col("least") < F.col("most")) & (some[0] | some[1] | some[2] | some[3])).select("title", *FIELDS)


def elect(candidates: DataFrame, votes: str = "sum") -> DataFrame:
    """The surviving value of each title and field: ``title, field, value, cand_id, score``.

    Fields are unpivoted to long rows, votes (source trust times recency decay) are
    summed per normalised value together with the value's best record, ``max_by`` elects
    a value of each field, and the winners are pivoted to one record per title.
    ``votes='sum'`` ranks values by their sum, then by their best record;
    ``votes='strongest'`` ranks them by their best record (the field's own standing,
    then trust: better quality, later, smaller id) and then by their sum, for rules in
    which any number of weaker records may not outvote a stronger one.  ``cand_id`` is
    the best record that gives the winning value, the one that supplies it.

    Groups have two or more records; repeated rows of one record count once in
    'strongest' votes.  Records without title or id belong to no group.  Blank
    fields and signs and words for "not known" are no values; a field that no record
    gives has no row; a null time is earlier than any other.  Both groupings combine
    partial aggregates before they shuffle, so one title with a third of all rows costs
    no task more than its share.
    """
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("w")) for f in FIELDS])
    return _elected(candidates, votes).select("title", F.inline(F.filter(listed, lambda x: x["w"].isNotNull()))).select("title", "field", "w.*")


def surviving_records(candidates: DataFrame, votes: str = "sum") -> DataFrame:
    """One record per title: the elected values, and the record that supplies each."""
    won = _elected(candidates, votes)
    return won.select("title", *[F.col(f"{f}.value").alias(f) for f in FIELDS], *[F.col(f"{f}.cand_id").alias(f"{f}_from") for f in FIELDS])
