"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.session import checkpointed

KEY = ("parent_table", "k1", "k2")

def _usable() -> Column:
    return F.col("k1").isNotNull() & F.col("k2").isNotNull()


def _tagged(parents: DataFrame, children: DataFrame, *kept: str) -> DataFrame:
    """Keys of both sides in long form: flags, times and, of children, the columns ``kept``."""
    types = dict(children.dtypes)
    none = lambda kind: F.lit(None).cast(kind)
    return (
        parents.where(_usable())
        .select(*KEY, F.lit(1).alias("p"), F.when(F.col("alive"), 1).otherwise(0).alias("alive"), F.when(F.col("alive"), F.col("since")).alias("since"),
                F.lit(0).alias("c"), none(types["at"]).alias("at"), *[none(types[k]).alias(k) for k in kept])
        .unionByName(children.where(_usable()).select(
            *KEY, F.lit(0).alias("p"), F.lit(0).alias("alive"), none(dict(parents.dtypes)["since"]).alias("since"), F.lit(1).alias("c"), "at", *kept))
    )


def orphan_references(parents: DataFrame, children: DataFrame) -> DataFrame:
    """The children whose parent is missing, deleted or delivered only later, with ``state``; repeated rows count once.

    ``parents``: ``parent_table, k1, k2, alive boolean, since timestamp``; a key is
    alive if one of its rows is, and exists since the earliest of the alive rows.
    ``children``: ``parent_table, k1, k2, at timestamp`` and any further columns,
    which are kept.  State is the first that holds of ``missing`` (no such parent),
    ``deleted`` (none alive) and ``late`` (alive only since after ``at``); other
    children are left out.  Keys compare as written; a null in a key has no parent,
    and a null time is never late.

    Tagged keys of both sides are unioned in long form and grouped once by parent
    table and key; keys that lack the parent flag, the alive flag or time are kept.
    All that is aggregated has a fixed width, so the grouping hashes, and children are
    one row per key and task before the shuffle.  Only the few bad keys then meet the
    children again; adaptive execution broadcasts them if their measured size allows,
    and splits skewed keys of the join otherwise.
    """
    bad = (
        _tagged(parents, children).groupBy(*KEY)
        .agg(F.max("p").alias("p"), F.max("alive").alias("alive"), F.min("since").alias("since"), F.max("c").alias("c"), F.min("at").alias("at"))
        .where((F.col("c") == 1) & ((F.col("p") == 0) | (F.col("alive") == 0) | (F.col("since") > F.col("at"))))
        .select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("p").alias("_p"), F.col("alive").alias("_alive"), F.col("since").alias("_since"))
    )
    same = [F.col(k) == F.col(f"_{k}") for k in KEY]
    state = (
        F.when(~_usable() | (F.col("_p") == 0), "missing").when(F.col("_alive") == 0, "deleted").when(F.col("_since") > F.col("at"), "late")
    )
    met = children.join(bad, same[0] & same[1] & same[2], "left").select(*children.columns, state.alias("state"))
    return met.where(F.col("state").isNotNull()).distinct()


def orphan_report(parents: DataFrame, children: DataFrame) -> DataFrame:
    """``table_name, field, period, state, references``: orphans counted in the grouping by parent key.

    Input as for ``orphan_references``; ``children`` have ``table_name, field`` too,
    and ``period`` is the month of ``at``.  References are counted by key and month,
    the counts of a key (as many as months and fields, however many references) are
    gathered beside its flags, and a key without parent or alive parent hands them on
    whole, as does a month wholly before the parent came.  Only of the one month in
    which the parent came do the references meet their key again.
    """
    once = children.distinct().withColumn("period", F.date_format("at", "yyyy-MM"))
    by = ["table_name", "field", "period"]
    counted = _tagged(parents, once, *by).groupBy(*KEY, *by).agg(
        F.max("p").alias("p"), F.max("alive").alias("alive"), F.min("since").alias("since"), F.sum("c").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    keys = counted.groupBy(*KEY).agg(
        F.max("p").alias("p"), F.max("alive").alias("alive"), F.min("since").alias("since"),
        F.collect_list(F.when(F.col("n") > 0, F.struct(*by, "n", "lo", "hi"))).alias("months"))
    state = (
        F.when(F.col("p") == 0, "missing").when(F.col("alive") == 0, "deleted").when(F.col("since") > F.col("hi"), "late").when(F.col("since") > F.col("lo"), "mixed")
    )
    stated = checkpointed(keys.select(*KEY, "p", "alive", "since", F.inline("months")).select(*KEY, "since", *by, "n", state.alias("state")).where(F.col("state").isNotNull()))
    mixed = stated.where(F.col("state") == "mixed").select(*[F.col(c).alias(f"_{c}") for c in (*KEY, *by)], F.col("since").alias("_since"))
    same = [F.col(c) == F.col(f"_{c}") for c in (*KEY, *by)]
    late = once.join(mixed, same[0] & same[1] & same[2] & same[3] & same[4] & same[5]).where(F.col("_since") > F.col("at"))
    parts = [
        stated.where(F.col("state") != "mixed").select(*by, "state", "n"),
        late.select(*by, F.lit("late").alias("state"), F.lit(1).cast("bigint").alias("n")),
        once.where(~_usable()).select(*by, F.lit("missing").alias("state"), F.lit(1).cast("bigint").alias("n")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*by, "state").agg(F.sum("n").alias("references"))


def catalog_references(entries: DataFrame, roms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(parents, children)`` of the four references of a catalog, for ``orphan_references``.

    ``entries``: rows in force with ``game_id, dat_id, name, cloneof, romof, isbios,
    removed, delivered_at, first_delivered``.  cloneof and romof name an entry of
    their catalog, bios an entry marked as BIOS, merge a member of the entry that
    romof of the member's own entry names.  Removed entries and their members refer
    to nothing, nor do nulls and empty texts.  Members of unknown entries do refer:
    their merge has no entry to name, so it is missing.

    Entries are written once.  Members meet their own entry in one join, of which each
    row gives both what refers and what is referred to.
    """
    entries = checkpointed(entries)
    time = dict(entries.dtypes)["delivered_at"]
    named = (
        entries.where(F.col("name").isNotNull() & F.col("dat_id").isNotNull())
        .groupBy("dat_id", "name")
        .agg(F.min(F.struct("removed", "first_delivered", "game_id")).alias("t"))
        .select(F.col("dat_id").alias("t_dat"), F.col("name").alias("t_name"), F.col("t.game_id").alias("target"))
    )
    own = entries.join(named, (F.col("dat_id") == F.col("t_dat")) & (F.col("romof") == F.col("t_name")), "left").select(
        F.col("game_id").alias("own_id"), F.col("removed").alias("own_removed"), F.col("first_delivered").alias("own_since"), "target"
    )

    def child(table_name: str, field: str, row_key: Column, parent_table: str, k1: Column, k2: str, at: Column, holds: Column) -> Column:
        made = F.struct(
            F.lit(table_name).alias("table_name"), F.lit(field).alias("field"), row_key.alias("row_key"), F.lit(parent_table).alias("parent_table"),
            k1.alias("k1"), F.col(k2).alias("k2"), at.cast(time).alias("at"), F.lit(None).cast("boolean").alias("alive"), F.lit(None).cast(time).alias("since"))
        return F.when(holds & (F.col(k2) != ""), made)

    def parent(parent_table: str, k1: Column, k2: str, alive: Column, since: Column, holds: Column) -> Column:
        made = F.struct(
            F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("bigint").alias("row_key"),
            F.lit(parent_table).alias("parent_table"), k1.alias("k1"), F.col(k2).alias("k2"), F.lit(None).cast(time).alias("at"), alive.alias("alive"), since.alias("since"))
        return F.when(holds, made)

    def rows(df: DataFrame, *made: Column) -> DataFrame:
        return df.select(F.inline(F.array_compact(F.array(*made))))

    live, since, dat, at = ~F.col("removed"), F.col("first_delivered"), F.col("dat_id"), F.col("delivered_at")
    of_entries = rows(
        entries, child("games", "cloneof", F.col("game_id"), "entry", dat, "cloneof", at, live), child("games", "romof", F.col("game_id"), "entry", dat, "romof", at, live),
        parent("entry", dat, "name", live, since, F.lit(True)), parent("bios", dat, "name", live, since, F.col("isbios") == "yes"))
    joined = roms.select("rom_id", "game_id", "dat_id", "name", "merge", "bios", "delivered_at").join(own, F.col("game_id") == F.col("own_id"), "left")
    refers = ~F.coalesce(F.col("own_removed"), F.lit(False))
    of_members = rows(
        joined, child("roms", "merge", F.col("rom_id"), "member", F.col("target"), "merge", at, refers), child("roms", "bios", F.col("rom_id"), "bios", dat, "bios", at, refers),
        parent("member", F.col("game_id"), "name", ~F.col("own_removed"), F.col("own_since"), F.col("own_id").isNotNull()))
    both = of_entries.unionByName(of_members)
    return (
        both.where(F.col("alive").isNotNull()).select(*KEY, "alive", "since"),
        both.where(F.col("field").isNotNull()).select("table_name", "field", "row_key", *KEY, "at"),
    )
