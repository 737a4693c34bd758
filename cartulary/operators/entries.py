"""Catalog entries in force: the last delivery of each entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_force(games: DataFrame, *columns: str) -> DataFrame:
    """One row for each ``game_id``: the row delivered last, its ``columns``, ``removed`` and ``first_delivered``.

    Repeated rows count once.  Of different rows delivered at one time the
    greater in column order holds; a null time is earlier than any other.  Rows
    without ``game_id`` have no identity and are left out.  Only the named columns
    are read.  One partial aggregation, one shuffle by ``game_id``.
    """
    kept = [c for c in dict.fromkeys(columns) if c not in ("game_id", "delivered_at")]
    latest = F.max(F.struct("delivered_at", "removed_at", *[c for c in kept if c != "removed_at"])).alias("last")
    return (
        games.where(F.col("game_id").isNotNull())
        .groupBy("game_id")
        .agg(latest, F.min("delivered_at").alias("first_delivered"))
        .select(
            "game_id",
            *[F.col(f"last.{c}").alias(c) for c in kept],
            F.col("last.delivered_at").alias("delivered_at"),
            F.col("last.removed_at").isNotNull().alias("removed"),
            "first_delivered",
        )
    )
