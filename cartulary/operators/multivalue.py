"""Several values packed in one field: infer delimiters per source, split, keep positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import UNKNOWN_WORDS, strip

HIT, CUT, OPEN, SHUT = "\u0001", "\u0002", "\u0003", "\u0004"


@dataclass(frozen=True)
class PackedField:
    """How values can be packed in a field.

    ``marks``: candidate delimiters, one character each.  ``spaced``: a mark counts
    only next to a space (titles); a comma then only between quoted values.
    ``quotes``: characters that enclose a value.  ``brackets``: a pair around the
    whole list is no part of it.  ``tags``: bracketed tags at the end are no values.
    ``piece``: what a regular piece looks like, by name of its type.
    """

    marks: tuple[str, ...]
    quotes: str
    spaced: bool
    brackets: bool
    tags: bool
    pieces: tuple[tuple[str, str], ...]
    least_score: float = 0.2
    prior: int = 50


#: Language lists: codes or quoted names, separated in any way.
LANGUAGES = PackedField(
    marks=(",", ";", "|", "/", "+", "&", "·", "•", "、", "，", "；", "\t", "\n", " "),
    quotes="\"'", spaced=False, brackets=True, tags=False,
    pieces=(("code", r"^[A-Za-z]{2,3}(?:[-_][A-Za-z0-9]{2,8})*$"), ("name", r"^\p{L}[\p{L}\p{M} ,;/()'-]{3,}$")),
)

#: Titles of compilations; ``&``, `` - `` and plain commas are parts of titles.
TITLES = PackedField(
    marks=("/", "+", "|", ";", "~", ","),
    quotes='"', spaced=True, brackets=False, tags=True,
    pieces=(("words", r"^\S+\s+\S.*$"), ("word", r"^\S+$")),
)


def _segments(text: Column, field: PackedField) -> Column:
    """``text`` cut into quoted stretches and the plain ones between them."""
    quoted = "|".join(f"{q}[^{q}]*{q}" for q in field.quotes)
    return F.regexp_extract_all(text, F.lit(f"({quoted}|[^{field.quotes}]+|[{field.quotes}])"), 1)


def _is_quoted(segment: Column, field: PackedField) -> Column:
    return (F.length(segment) > 1) & F.substring(segment, 1, 1).isin(*field.quotes)


def _body(value: Column, field: PackedField) -> Column:
    """The part of a field that holds values: without brackets around it or tags at its end."""
    text = strip(value)
    if field.brackets:
        first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
        paired = ((first == "[") & (last == "]")) | ((first == "(") & (last == ")")) | ((first == "{") & (last == "}"))
        text = F.when(paired & (F.length(text) > 1), text.substr(F.lit(2), F.length(text) - 2)).otherwise(text)
    if field.tags:
        marked = F.regexp_replace(text, r"(\([^()]*\)|\[[^\[\]]*\])", f"{OPEN}$1{SHUT}")
        pieces = F.split(marked, OPEN)
        rest = F.transform(pieces, lambda p, i: F.when(i == 0, F.lit(0)).when(
            F.length(strip(F.substring_index(p, SHUT, -1))) > 0, i).otherwise(F.lit(0)))
        kept = F.slice(pieces, 1, F.array_max(rest) + 1)
        text = strip(F.translate(F.array_join(kept, ""), OPEN + SHUT, ""))
    return text


def _flagged(segments: Column, field: PackedField) -> Column:
    """The text with a sign before each mark that stands where a delimiter can stand."""
    marks = "".join("\\" + m if m in "|/+\\]^-[" else m for m in field.marks if m != "," or not field.spaced)
    if not field.spaced:
        def flag(segment: Column, _: Column) -> Column:
            return F.when(_is_quoted(segment, field), segment).otherwise(F.regexp_replace(segment, f"([{marks}])", f"{HIT}$1"))

        return F.array_join(F.transform(segments, flag), "")

    last = F.size(segments) - 1

    def flag_spaced(segment: Column, i: Column) -> Column:
        plain = F.regexp_replace(segment, f"((?<=\\s)[{marks}]|[{marks}](?=\\s))", f"{HIT}$1")
        comma = F.regexp_replace(segment, ",", f"{HIT},")
        return (
            F.when(_is_quoted(segment, field), segment)
            .when((i > 0) & (i < last) & segment.rlike(r"^\s*,\s*$"), comma)
            .otherwise(plain)
        )

    return F.array_join(F.transform(segments, flag_spaced), "")


def _values(flagged: Column, field: PackedField, accepted: Column) -> Column:
    """Values of a flagged text: cut at the accepted marks, bare of blanks and quotes, none empty."""
    text = flagged
    for mark in field.marks:
        text = F.replace(text, F.lit(HIT + mark), F.when(F.array_contains(accepted, mark), CUT).otherwise(mark))

    def bare(piece: Column) -> Column:
        value = strip(piece)
        enclosed = F.lit(False)
        for quote in field.quotes:
            enclosed = enclosed | ((F.substring(value, 1, 1) == quote) & (F.substring(value, -1, 1) == quote))
        return F.when(enclosed & (F.length(value) > 1), strip(value.substr(F.lit(2), F.length(value) - 2))).otherwise(value)

    return F.filter(F.transform(F.split(text, CUT), bare), lambda v: F.length(v) > 0)


def _equals(name: str):
    return lambda kind: kind == name


def infer_delimiters(flagged: DataFrame, field: PackedField) -> DataFrame:
    """``source, accepted array<string>``: the marks that separate values in each source.

    ``flagged``: ``source, text`` with signs before candidate marks.  For each source
    and mark, the values cut at that mark alone are scored: consistency, 1 / (1 +
    squared coefficient of variation of the logarithm of piece counts, up to 1,024
    pieces, so that no single value of very many decides), times regularity, the share of pieces
    that are of the most frequent piece type, of which ``word`` and irregular pieces
    count nothing in titles.  Few observations are drawn towards the score of the
    mark over all sources, so thin sources follow the others.  All sums are partial
    aggregates over values; the result has one row per source.
    """
    cut = flagged.where(F.contains("text", F.lit(HIT))).select(
        "source",
        F.explode(F.filter(F.array(*[
            F.struct(F.lit(m).alias("mark"), F.split(F.col("text"), F.lit(HIT + ("\\" if m in "|+" else "") + m)).alias("pieces"))
            for m in field.marks]), lambda x: F.size(x["pieces"]) > 1)).alias("c"))

    edges = r"\s" + "".join("\\" + m for m in field.marks if not m.isspace())

    def kind(piece: Column) -> Column:
        value = strip(F.translate(piece, HIT + field.quotes, ""))
        if not field.spaced:  # what other marks leave at the edges says nothing about this one
            value = F.regexp_replace(value, f"^[{edges}]+|[{edges}]+$", "")
        name = F.lit("other")
        for label, pattern in reversed(field.pieces):
            name = F.when(value.rlike(pattern), label).otherwise(name)
        return F.when(F.length(value) == 0, "empty").otherwise(name)

    observed = cut.select(
        "source", F.col("c.mark").alias("mark"), F.least(F.log2(F.size("c.pieces").cast("double")), F.lit(10.0)).alias("n"),
        F.transform("c.pieces", kind).alias("kinds"))
    regular = [label for label, _ in field.pieces if label != "word"]
    sums = observed.groupBy("source", "mark").agg(
        F.count("*").alias("values"), F.sum("n").alias("s1"), F.sum(F.col("n") * F.col("n")).alias("s2"),
        F.sum(F.size(F.filter("kinds", lambda k: k != "empty"))).alias("filled"),
        *[F.sum(F.size(F.filter("kinds", _equals(r)))).alias(f"k_{r}") for r in regular],
    )
    total = sums.groupBy("mark").agg(*[F.sum(c).alias(c) for c in sums.columns[2:]])

    def score() -> Column:
        mean = F.col("s1") / F.col("values")
        variance = F.greatest(F.col("s2") / F.col("values") - mean * mean, F.lit(0.0))
        best = F.greatest(*[F.col(f"k_{r}") for r in regular]) if len(regular) > 1 else F.col(f"k_{regular[0]}")
        return (F.lit(1.0) / (F.lit(1.0) + variance / (mean * mean))) * best / F.greatest(F.col("filled"), F.lit(1))

    everywhere = total.select(F.col("mark").alias("g_mark"), score().alias("g_score"))
    mixed = (F.col("values") * F.col("score") + field.prior * F.col("g_score")) / (F.col("values") + field.prior)
    return (
        sums.select("source", "mark", "values", score().alias("score"))
        .join(F.broadcast(everywhere), F.col("mark") == F.col("g_mark"))  # at most one row per candidate mark
        .where(mixed >= field.least_score)
        .groupBy("source")
        .agg(F.array_sort(F.collect_set("mark")).alias("accepted"))
    )


def split_values(df: DataFrame, key: str, value: str, source: str, field: PackedField) -> DataFrame:
    """``row_key, pos, value``: every value of the fields that hold two or more, from position 1.

    Delimiters are inferred per source, then each field is cut at the delimiters of
    its source outside quotes, and the non-empty pieces are exploded with their
    position; repeated values stay.  Rows of equal key and text count once.  Null,
    blank and single-valued fields and words for "not known" give no rows; a null
    source is a source of its own.  A quote without its partner is a plain character.
    The text is scanned by expressions of linear cost, so very long fields are safe.

    Two shuffles: one drops repeats, one sums scores (pre-aggregated, a row per
    source and mark).  The marks meet the fields by a join on source, which adaptive
    execution broadcasts while the list of sources is small and splits where a
    source is skewed.
    """
    plain = strip(F.col("value"))
    base = (
        df.select(F.col(key).alias("row_key"), F.col(source).cast("string").alias("source"), F.col(value).alias("value"))
        .where(F.length(plain) > 0)
        .where(~F.lower(plain).isin(*UNKNOWN_WORDS))
    )
    base = base.select("row_key", "source", _flagged(_segments(_body(F.col("value"), field), field), field).alias("text"))
    base = base.where(F.contains("text", F.lit(HIT))).distinct()
    marks = infer_delimiters(base.select("source", "text"), field).withColumnRenamed("source", "m_source")
    return (
        base.join(marks, F.col("source").eqNullSafe(F.col("m_source")))
        .select("row_key", _values(F.col("text"), field, F.col("accepted")).alias("values"))
        .where(F.size("values") > 1)
        .select("row_key", F.posexplode("values").alias("at", "value"))
        .select("row_key", (F.col("at") + 1).cast("bigint").alias("pos"), "value")
    )
