"""Places of rows in an order, without sorting any group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.session import written


def ranked(rows: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rank``: the place, from 0, of each row within ``part`` by ``order``.

    Rows are sorted over ranges of all these columns, so one part with all rows is spread
    over many tasks; a row's place is the number of rows in the ranges before its own
    plus that inside it.  Only one count for each range is gathered.
    """
    cut = [F.col(c) for c in (*part, *order)]
    low = (1 << 33) - 1
    placed = written(rows.repartitionByRange(*cut).sortWithinPartitions(*cut).withColumn("at", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("range", F.coalesce(before, F.lit(0)).alias("start"))
    numbered = placed.join(starts, F.shiftright("at", 33) == F.col("range")).withColumn("at", F.col("start") + F.col("at").bitwiseAND(F.lit(low))).drop("range", "start")
    if not part:
        return numbered.withColumnRenamed("at", "rank")
    firsts = numbered.groupBy(*[F.col(c).alias(f"p_{c}") for c in part]).agg(F.min("at").alias("first"))
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in part]
    met = numbered.join(firsts, reduce(lambda x, y: x & y, same))
    return met.withColumn("rank", F.col("at") - F.col("first")).drop("at", "first", *[f"p_{c}" for c in part])
