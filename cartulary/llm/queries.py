"""Queries of the corpus problems 1, 2, 8, 9 and 10, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.canonical import map_records
from cartulary.llm.leakage import leaked_items
from cartulary.llm.reading import reading_levels
from cartulary.llm.survivor import FIELDS, elect, surviving_records
from cartulary.llm.tokens import encode_documents
from cartulary.session import table


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "file_records").select(
        F.lit("file_records").alias("table_name"), F.col("file_id").alias("record_id"), F.lit("derived_platform").alias("field"),
        F.lit(1).cast("bigint").alias("pos"), F.lit("platform").alias("kind"), F.col("derived_platform").alias("value")).where(F.col("value").isNotNull()).distinct()
    cache = table(spark, sf_dir, "igdb_cache").select(
        "cache_id",
        F.inline(F.array(F.struct(F.lit("platforms").alias("field"), F.lit("platform").alias("kind"), F.col("platforms").alias("typed")),
                         F.struct(F.lit("genres").alias("field"), F.lit("genre").alias("kind"), F.col("genres").alias("typed")))))
    cache = cache.select("cache_id", "field", "kind", F.posexplode("typed").alias("at", "value")).where(F.col("value").isNotNull()).select(
        F.lit("igdb_cache").alias("table_name"), F.col("cache_id").alias("record_id"), "field", (F.col("at") + 1).cast("bigint").alias("pos"), "kind", "value")
    return files.unionByName(cache)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical token of each platform and genre that is not written exactly."""
    return map_records(_typed(spark, sf_dir), table(spark, sf_dir, "canonical_values")).select("table_name", "record_id", "field", "pos", "token")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that stand for no entry, with their number."""
    mapped = map_records(_typed(spark, sf_dir), table(spark, sf_dir, "canonical_values"))
    return mapped.where(F.col("token") == "").groupBy("table_name", "field", "value").agg(F.count("*").alias("rows"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that supplies the surviving value of each title and field."""
    return elect(table(spark, sf_dir, "candidates"), votes="strongest").select("title", "field", "cand_id")


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per title by summed votes of trust and recency."""
    return surviving_records(table(spark, sf_dir, "candidates"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return encode_documents(table(spark, sf_dir, "documents"))


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens of each source."""
    coded = encode_documents(table(spark, sf_dir, "documents")).select("doc_id", F.size("ids").cast("bigint").alias("tokens"))
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "source")
    return coded.join(sources, F.col("doc_id") == F.col("d")).groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each evaluation item that leaked into it."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items that leaked, with the number of documents that hold them."""
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of the English documents of reading sources with 40 words or more."""
    documents = table(spark, sf_dir, "documents")
    wanted = documents.where((F.col("lang") == "en") & F.col("source").isin("manual", "wiki", "readme", "guide"))
    words = F.filter(F.split("text", r"[\s\p{Z}\u0085]+"), lambda w: w != "")
    return reading_levels(wanted.where(F.size(words) >= 40), documents, table(spark, sf_dir, "reading_samples"))


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_records, p8_ids, p8_lengths, p9_found, p9_items, p10_found)}

_KNOWN = "(regexp_matches({0}, '[\\p{{L}}\\p{{N}}]') AND lower(trim({0})) NOT IN ('unknown', 'n/a', 'na', 'none', 'null', 'nil', 'not known', 'not given', 'none given', 'not available', 'not specified', 'unspecified', 'undefined', 'missing', 'tbd', 'tba', 'nan'))"

_VALUES = f"""
WITH c AS (SELECT *, coalesce(list_position(['bad', 'modified', 'clean', 'pending', 'fixed', 'verified'], lower(trim(quality))), 0) AS q,
    list_sort(list_distinct(list_transform(list_filter(languages, lambda x: coalesce({_KNOWN.format('x')}, false)), lambda x: lower(trim(x))))) AS langs,
    regexp_replace(lower(trim(revision)), '^\\(\\s*|\\s*\\)$', '', 'g') AS rev, count(*) OVER (PARTITION BY title) AS n,
    3600 + coalesce(least(greatest(epoch_us(updated_at) // 86400000000 - 18262, -3600), 3600), -3600) AS age
  FROM candidates WHERE title IS NOT NULL),
k AS (SELECT *, coalesce(len(langs), 0) AS n_lang, CASE WHEN regexp_matches(rev, '^prg\\s*\\d+$') THEN 4 WHEN regexp_matches(rev, '^v\\s*\\d+(\\.\\d+)*$') THEN 3
    WHEN regexp_matches(rev, '^rev\\s*\\d+$') THEN 2 WHEN regexp_matches(rev, '^rev\\s*[a-z]$') THEN 1 ELSE 0 END AS kind,
    (3 ** q)::HUGEINT * (2 ** (age // 180))::HUGEINT * (180 + age % 180) AS weight FROM c WHERE n > 1),
v AS (SELECT *, CASE WHEN kind >= 2 THEN list_transform(string_split(regexp_extract(rev, '[0-9.]+$'), '.'), lambda x: x::BIGINT)
    WHEN kind = 1 THEN [ascii(right(rev, 1))::BIGINT] ELSE [0::BIGINT] END AS nums FROM k),
f AS (
  SELECT title, 'region' AS field, cand_id, q, updated_at, weight, lower(trim(region)) AS value, 0 AS a, [0, 0, 0, 0]::BIGINT[] AS b FROM v WHERE coalesce({_KNOWN.format('region')}, false)
  UNION ALL SELECT title, 'quality', cand_id, q, updated_at, weight, lower(trim(quality)), 0, [0, 0, 0, 0]::BIGINT[] FROM v WHERE coalesce({_KNOWN.format('quality')}, false)
  UNION ALL SELECT title, 'languages', cand_id, q, updated_at, weight, array_to_string(langs, ','), n_lang, [0, 0, 0, 0]::BIGINT[] FROM v WHERE n_lang > 0
  UNION ALL SELECT title, 'revision', cand_id, q, updated_at, weight, lower(trim(revision)), kind, [coalesce(nums[1], 0), coalesce(nums[2], 0), coalesce(nums[3], 0), coalesce(nums[4], 0)] FROM v WHERE coalesce({_KNOWN.format('revision')}, false))
"""
_BEST = "a DESC, b[1] DESC, b[2] DESC, b[3] DESC, b[4] DESC, q DESC, updated_at DESC NULLS LAST, cand_id"

ORACLE_SQL = {
    "p2_found": f"{_VALUES} SELECT title, field, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY title, field ORDER BY {_BEST}) AS rn FROM f) WHERE rn = 1",
    "p2_records": f"""{_VALUES}, s AS (SELECT *, sum(weight) OVER (PARTITION BY title, field, value) AS votes FROM f),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, field ORDER BY votes DESC, {_BEST}) AS rn FROM s) WHERE rn = 1)
SELECT title, {', '.join(f"max(value) FILTER (field = '{x}') AS {x}" for x in FIELDS)}, {', '.join(f"max(cand_id) FILTER (field = '{x}') AS {x}_from" for x in FIELDS)} FROM w GROUP BY title""",
}
