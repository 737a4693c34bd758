"""Free-entered values mapped to entries of a reference list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import fold
from cartulary.session import checkpointed

#: Roman numerals that stand for numbers when they are a token.
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}

#: Edits allowed in a token by its length; below the first length it must be exact.
ONE_EDIT_FROM, TWO_EDITS_FROM = 3, 5
#: Least score, and least share that is found of an entry's weight and of its letters.
LEAST_SCORE, LEAST_COVER, LEAST_LETTERS = 0.62, 0.7, 0.6
#: Squared weight of a value's token without counterpart, outside and inside the vocabulary.
FILLER, STRANGER = 0.25, 0.5


def _once(tokens: Column) -> Column:
    # Distinct strings are found by hash; a sign and the place keep single letters apart.
    marked = F.transform(tokens, lambda t, i: F.when(F.length(t) == 1, F.concat(t, F.lit("#"), i.cast("string"))).otherwise(t))
    return F.transform(F.array_distinct(marked), lambda m: F.substring_index(m, "#", 1))


def tokens_of(value: Column, numerals: bool = True) -> Column:
    """Plain tokens of a value: folded letters and digits, Roman numerals as numbers; words (not single letters) once each."""
    plain = F.trim(F.regexp_replace(F.replace(fold(value), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))
    tokens = F.filter(F.split(plain, " "), lambda t: t != "")
    if not numerals:
        return _once(tokens)
    roman = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    return _once(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(roman, t), t)))


def _runs(tokens: Column, letters: Column) -> Column:
    """Every run of neighbouring tokens that has up to ``letters`` letters when joined, with its place: ``(seg, lo, hi)``."""
    n = F.size(tokens)

    def from_(lo: Column) -> Column:
        # A token has a letter at least, so no run has more tokens than letters.
        runs = F.transform(F.sequence(F.lit(1), F.least(letters, n - lo)), lambda k: F.struct(
            F.array_join(F.slice(tokens, lo + 1, k), "").alias("seg"), lo.cast("int").alias("lo"), (lo + k).cast("int").alias("hi")))
        return F.filter(runs, lambda r: F.length(r["seg"]) <= letters)

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), from_)))


def _deletions(text: Column) -> Column:
    """``text`` and all it becomes by up to two deletions, as its length allows edits."""

    def once(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), s.substr(i + 1, F.length(s))))

    one = F.array_distinct(once(text))
    return (
        F.when(F.length(text) >= TWO_EDITS_FROM, F.array_distinct(F.concat(F.array(text), one, F.flatten(F.transform(one, once)))))
        .when(F.length(text) >= ONE_EDIT_FROM, F.concat(F.array(text), one))
        .otherwise(F.array(text))
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{N}]", "")


def reference_forms(reference: DataFrame) -> DataFrame:
    """Spellings of the entries: ``kind, token, form_id, tokens, weights, exact``, weights being IDF.

    ``reference``: ``kind, token, name, abbreviation``.  An abbreviation is a spelling
    that only an exact match can mean.
    """
    written = F.array(
        F.struct(F.col("token").alias("text"), F.lit(False).alias("exact")),
        F.struct(F.col("name").alias("text"), F.lit(False).alias("exact")),
        F.struct(F.col("abbreviation").alias("text"), F.lit(True).alias("exact")),
    )
    forms = (
        reference.where(F.col("token").isNotNull()).select("kind", "token", F.inline(written))
        # Numerals written on to a word stay letters, so both spellings of a number are forms.
        .select("kind", "token", "exact", F.explode(F.array(tokens_of(F.col("text")), tokens_of(F.col("text"), False))).alias("tokens"))
        .where(F.size("tokens") > 0).groupBy("kind", "token", "tokens").agg(F.min("exact").alias("exact"))
    )
    known = forms.where(~F.col("exact"))
    entries = known.groupBy("kind").agg(F.count_distinct("token").alias("entries"))
    spread = known.select("kind", "token", F.explode("tokens").alias("t")).groupBy("kind", "t").agg(F.count_distinct("token").alias("df"))
    weights = spread.join(entries, "kind").select("kind", "t", (F.log1p(F.col("entries") / F.col("df")) / F.log1p("entries")).alias("w"))
    numbered = forms.withColumn("form_id", F.xxhash64("kind", "token", "tokens"))
    # Each token of a spelling meets its weight by a join, and a spelling gathers its own few again.
    placed = numbered.select("kind", "form_id", F.posexplode("tokens").alias("at", "t")).join(weights, ["kind", "t"], "left")
    gathered = placed.groupBy(F.col("form_id").alias("g_id")).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("w", F.lit(1.0)).alias("w")))).alias("g"))
    return numbered.join(gathered, F.col("form_id") == F.col("g_id")).select(
        "kind", "token", "exact", "tokens", "form_id", F.transform("g", lambda x: x["w"]).alias("weights"))


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """``kind, tokens, token, score``: the entry of each distinct tokenised value, ``''`` if it stands for none.

    ``values``: ``kind, tokens`` (from ``tokens_of``).  Each distinct token of the
    values, also any number of neighbouring tokens joined, meets the vocabulary of the
    reference list (tokens and joined tokens of all spellings) by edit distance: both
    sides are reduced to what up to two deletions leave, equal remains are joined, so
    no pair within two edits or swaps is missed and none is enumerated.  Digits must
    agree.  A value's corrected tokens are then compared with each spelling they touch
    by soft TF-IDF: found weight times similarity over the lengths of both, where tokens
    outside the vocabulary weigh little and vocabulary words without counterpart weigh
    more.  A number on one side only excludes a spelling.  The best entry must reach
    ``LEAST_SCORE`` and cover its spelling to ``LEAST_COVER`` by weight and
    ``LEAST_LETTERS`` by letters; ties go to the longer
    spelling, then to the smaller token.

    Values without tokens, of unknown kinds or of an empty list map to ``''``.  Only
    distinct values and tokens are shuffled, so frequency of a value has no cost.
    Spellings, distinct values and corrected runs are written to the checkpoint folder.
    """
    # What later steps use again is written once: spellings, distinct values, corrected runs.
    forms = checkpointed(reference_forms(reference))
    vocabulary = forms.select(
        "kind", "form_id", "exact", "tokens", F.size("tokens").alias("n"), F.inline(_runs(F.col("tokens"), F.length(F.array_join("tokens", ""))))
    ).where(~F.col("exact") | ((F.col("lo") == 0) & (F.col("hi") == F.col("n"))))
    # Edits of a joined term may not stand for a whole token of it, so they stay below its shortest word.
    lengths = F.transform(F.filter(F.slice("tokens", F.col("lo") + 1, F.col("hi") - F.col("lo")), lambda t: t.rlike(r"\p{L}")), F.length)
    slack = F.when(F.col("hi") - F.col("lo") > 1, F.coalesce(F.array_min(lengths), F.lit(1)) - 1).otherwise(2)
    terms = vocabulary.select("kind", F.col("seg").alias("term"), "exact", slack.alias("slack")).groupBy("kind", "term").agg(
        F.min("exact").alias("exact"), F.max("slack").alias("slack"))
    longest = terms.groupBy(F.col("kind").alias("l_kind")).agg(F.max(F.length("term")).alias("longest"))
    # Runs refer to their value by its digest, so a long value is not repeated in each of them.
    every = checkpointed(values.select("kind", "tokens").distinct())
    distinct = every.where(F.size("tokens") > 0).withColumn("vid", F.md5(F.array_join("tokens", " ")))
    # A run longer than any term of its kind by more than two edits can match none; there is one row for each kind.
    runs = distinct.join(F.broadcast(longest), F.col("kind") == F.col("l_kind")).select("kind", "vid", F.inline(_runs(F.col("tokens"), F.col("longest") + 2)))
    segments = runs.select("kind", "seg").distinct()
    left = segments.select("kind", "seg", _digits(F.col("seg")).alias("d"), F.explode(_deletions(F.col("seg"))).alias("rest"))
    right = terms.select("kind", "term", "exact", "slack", _digits(F.col("term")).alias("d"),
                         F.explode(F.when(F.col("exact"), F.array("term")).otherwise(_deletions(F.col("term")))).alias("rest"))
    deleted = F.greatest(F.length("seg"), F.length("term")) - F.length("rest")
    shorter = F.least(F.length("seg"), F.length("term"))
    cost = F.col("steps") + 0.25 * (F.levenshtein("seg", "term") - F.col("steps"))
    repaired = checkpointed(
        # Either side is many times what the planner takes it for, so neither may be broadcast on its estimate.
        left.hint("merge").join(right.hint("merge"), ["kind", "d", "rest"])
        .groupBy("kind", "seg", "term", "exact", "slack").agg(F.min(deleted).alias("steps"))
        .where((F.col("seg") == F.col("term")) | (~F.col("exact") & (shorter >= ONE_EDIT_FROM)
               & (F.col("steps") <= F.least("slack", F.when(shorter >= TWO_EDITS_FROM, 2).otherwise(1)))))
        .select("kind", "seg", "term", (F.lit(1.0) - cost / F.greatest(F.length("seg"), F.length("term"))).alias("sim"))
    )
    place = vocabulary.select("kind", F.col("seg").alias("term"), "form_id", F.col("lo").alias("f_lo"), F.col("hi").alias("f_hi"))
    met = (
        runs.join(repaired, ["kind", "seg"])
        .join(place, ["kind", "term"])
        .groupBy("kind", "vid", "form_id")
        .agg(F.collect_set(F.struct("lo", "hi", "f_lo", "f_hi", "sim")).alias("met"))
    )
    # Words of a value that the vocabulary knows, whatever spelling they belong to.
    known = runs.where(F.col("hi") - F.col("lo") == 1).join(repaired.where(F.col("sim") >= 0.6).select("kind", "seg").distinct(), ["kind", "seg"]).groupBy(
        "kind", "vid").agg(F.collect_set("lo").alias("known"))
    joined = met.join(forms.select(F.col("form_id").alias("id"), "token", F.col("tokens").alias("form"), "weights"), F.col("form_id") == F.col("id")).join(
        known, ["kind", "vid"], "left").join(distinct, ["kind", "vid"])

    def covers(lo: str, hi: str):
        return lambda p: F.coalesce(F.array_max(F.transform(F.filter("met", lambda m: (m[lo] <= p) & (p < m[hi])), lambda m: m["sim"])), F.lit(0.0))

    places = F.sequence(F.lit(0), F.size("form") - 1)
    own = F.sequence(F.lit(0), F.size("tokens") - 1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    scored = joined.select(
        "kind", "tokens", "token", "form", "weights", "known", F.transform(places, covers("f_lo", "f_hi")).alias("s"), F.transform(own, covers("lo", "hi")).alias("v")
    ).select(
        "kind", "tokens", "token", F.size("form").alias("size"),
        total(F.zip_with("s", "weights", lambda s, w: s * w * w)).alias("found"),
        total(F.zip_with("s", "weights", lambda s, w: F.when(s > 0, w * w).otherwise(0.0))).alias("mine"),
        total(F.transform("weights", lambda w: w * w)).alias("all"),
        total(F.transform("v", lambda s, i: F.when(s > 0, 0.0).when(F.array_contains(F.coalesce("known", F.array().cast("array<int>")), i), STRANGER).otherwise(FILLER))).alias("rest"),
        total(F.zip_with("s", "form", lambda s, t: s * F.length(t))).alias("letters"),
        F.length(F.array_join("form", "")).alias("all_letters"),
        F.exists(F.zip_with("s", "form", lambda s, t: (s == 0) & t.rlike(r"\p{N}")), lambda x: x).alias("lacks"),
        F.exists(F.zip_with("v", "tokens", lambda s, t: (s == 0) & t.rlike(r"\p{N}")), lambda x: x).alias("extra"),
    )
    best = (
        scored.where(~F.col("lacks") & ~F.col("extra") & (F.col("found") >= LEAST_COVER * F.col("all"))
                     & (F.col("letters") >= LEAST_LETTERS * F.col("all_letters")))
        .select("kind", "tokens", "token", "size", (F.col("found") / F.sqrt(F.col("all") * (F.col("mine") + F.col("rest")))).alias("score"))
        .where(F.col("score") >= LEAST_SCORE)
        .groupBy("kind", "tokens", "token").agg(F.max(F.struct("score", "size")).alias("b"))
        .groupBy("kind", "tokens").agg(F.max_by("token", F.struct(F.col("b.score"), F.col("b.size"))).alias("token"), F.max("b.score").alias("score"))
    )
    return every.join(best, ["kind", "tokens"], "left").select("kind", "tokens", F.coalesce("token", F.lit("")).alias("token"), "score")


def map_records(cases: DataFrame, reference: DataFrame) -> DataFrame:
    """``cases`` (``kind, value`` and any further columns) with the ``token`` each value means.

    Cases written exactly as a name or token of their kind are left out, as are blank ones.
    """
    exact = reference.select("kind", F.explode(F.array("token", "name")).alias("value")).where(F.col("value").isNotNull()).distinct()
    typed = (
        cases.where(F.length(F.regexp_replace("value", r"[\s\p{Z}]+", "")) > 0)
        .join(exact.withColumnRenamed("kind", "e_kind").withColumnRenamed("value", "e_value"), (F.col("kind") == F.col("e_kind")) & (F.col("value") == F.col("e_value")), "left_anti")
        .withColumn("tokens", tokens_of(F.col("value")))
    )
    mapped = map_values(typed, reference).select(F.col("kind").alias("m_kind"), F.col("tokens").alias("m_tokens"), "token", "score")
    return typed.join(mapped, (F.col("kind") == F.col("m_kind")) & (F.col("tokens") == F.col("m_tokens"))).drop("m_kind", "m_tokens", "tokens")
