"""Differences between two copies of a dataset."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def compare_copies(
    first: DataFrame,
    mirror: DataFrame,
    key: str,
    fields: Mapping[str, Callable[[Column], Column] | None],
) -> DataFrame:
    """Rows ``(row_key, field, state)`` for all that differs between two copies.

    Both sides are tagged and unioned; one grouping by key collects one struct per
    side, and generated higher-order SQL compares the structs field by field.
    ``fields`` maps each compared field to an expression that brings it to its
    comparable form, or to None where it compares as written.

    A key in one copy only gives one row with field ``''`` and state ``only_first``
    or ``only_mirror``; other keys give a ``differs`` row for each field that
    differs.  Null equals null and differs from any value.  Repeated rows of a side
    count once; where rows of one key disagree within a side, that is a row with field
    ``''`` and state ``unlike_first`` or ``unlike_mirror`` besides, and the greatest struct
    stands for the side.  Rows with a null key are compared like those of any other key.
    Empty copies and further columns on either side are allowed.

    Only key and fields are read.  The per-side maxima are combined before the
    single shuffle, so a key that is repeated without end stays one row per task.
    """
    names = list(fields)

    def side(df: DataFrame, tag: str) -> DataFrame:
        values = [(fields[f] or (lambda c: c))(df[_quoted(f)]) for f in names]
        record = F.struct(*[v.alias(f"f{i}") for i, v in enumerate(values)])
        # A hash passes over nulls, so each value is told from a null besides.
        rows = df.select(df[_quoted(key)].alias("row_key"), F.lit(tag).alias("side"), record.alias("rec"))
        parts = [F.col(f"rec.f{i}") for i in range(len(names))]
        return rows.withColumn("print", F.xxhash64(*parts, *[p.isNull() for p in parts]))

    grouped = (
        side(first, "first")
        .unionByName(side(mirror, "mirror"))
        .groupBy("row_key")
        .agg(*[
            made for tag, name in (("first", "a"), ("mirror", "b"))
            for made in (F.max(F.when(F.col("side") == tag, F.col("rec"))).alias(name), F.min(F.when(F.col("side") == tag, F.col("print"))).alias(f"{name}_least"),
                         F.max(F.when(F.col("side") == tag, F.col("print"))).alias(f"{name}_most"))])
    )
    literal = [n.replace("\\", "\\\\").replace("'", "\\'") for n in names]
    compared = ", ".join(
        f"named_struct('field', '{n}', 'same', a.f{i} <=> b.f{i})" for i, n in enumerate(literal)
    )
    cases = f"""CASE
        WHEN b IS NULL THEN array(named_struct('field', '', 'state', 'only_first'))
        WHEN a IS NULL THEN array(named_struct('field', '', 'state', 'only_mirror'))
        ELSE transform(filter(array({compared}), x -> NOT x.same),
                       x -> named_struct('field', x.field, 'state', 'differs')) END"""
    unlike = """filter(array(IF(a_least < a_most, named_struct('field', '', 'state', 'unlike_first'), NULL),
                            IF(b_least < b_most, named_struct('field', '', 'state', 'unlike_mirror'), NULL)), x -> x IS NOT NULL)"""
    return grouped.select("row_key", F.expr(f"inline(concat({cases}, {unlike}))"))
