from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from cartulary.llm import survivor as S

SCHEMA = "cand_id bigint, title string, region string, languages array<string>, quality string, revision string, updated_at timestamp, field string, value string, trust string"
D = [dt.datetime(2024, 1, d) for d in range(1, 29)]


def run(spark, rows, votes="strongest"):
    df = spark.createDataFrame([(*r, "f", "v", "t") for r in rows], SCHEMA)
    return {(r.title, r.field): r.cand_id for r in S.elect(df, votes).collect()}


def test_rules(spark):
    rows = [
        (1, "a", "USA", ["En"], "clean", "Rev 2", D[0]), (2, "a", " ? ", ["En", "en ", "?", None], "Verified ", "(v1.2)", D[1]), (3, "a", "Japan", ["Ja", "Fr"], "bad", "v1.10", D[2]),
        (4, "a", None, None, None, "PRG0", None), (5, "b", "USA", ["En"], "clean", "Rev 1", D[0]), (6, "c", "-", [], "?", "n/a", D[0]), (7, "c", " ", [" "], None, None, D[0]),
        (8, None, "USA", ["En"], "clean", "Rev 1", D[0]), (9, None, "USA", ["En"], "clean", "Rev 1", D[0]), (10, "d", "USA", None, "fixed", "v1.0", D[3]), (11, "d", "Korea", None, "FIXED", "V1", D[3]),
        (11, "d", "Korea", None, "FIXED", "V1", D[3]), (12, "e", "USA", None, None, None, D[1]), (12, "e", "USA", None, None, None, D[1]),
    ]
    got = run(spark, rows)
    assert got == {("a", "region"): 1, ("a", "languages"): 3, ("a", "quality"): 2, ("a", "revision"): 4, ("d", "region"): 10, ("d", "quality"): 10, ("d", "revision"): 10}


def test_revision_order(spark):
    ordered = ["odd", "Rev A", "rev b", "Rev AA", "REV01", "Rev 2", "rev 10", "v 0.9", "V1.2", "(v1.2.0)", "v1.10", "v1.10.1", "PRG0", "(prg 12)"]
    df = spark.createDataFrame(list(enumerate(ordered)), "i int, r string").withColumn("p", F.lower("r")).withColumn("k", S.revision_key(F.coalesce(F.regexp_extract("p", S._REVISION, 1), F.lit("")), F.regexp_extract("p", S._REVISION, 2)))
    keys = [(r.k.kind, list(r.k.numbers)) for r in df.orderBy("i").collect()]
    assert keys == sorted(keys) and keys[8] == keys[9]


def test_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [
        (i, f"t{rng.randrange(3) if i % 3 else 0}", rng.choice(["USA", "", None, "n/a", "Japan"]), rng.choice([None, [], ["En"], ["En", "Fr", "fr"], ["?"]]),
         rng.choice(["clean", "Bad", None, "verified", "?"]), rng.choice(["Rev 1", "v1.1", None, "-", "PRG1"]), rng.choice(D)) for i in range(300)
    ]
    given = lambda v: v is not None and v.strip() not in ("", "?", "-", "n/a")
    rank = {"verified": 6, "clean": 3, "bad": 1}
    trust = lambda r: (rank.get((r[4] or "").lower(), 0), r[6], -r[0])
    langs = lambda r: len({x.lower() for x in r[3] or [] if given(x)})
    order = {"Rev 1": 2, "v1.1": 3, "PRG1": 4}
    want = {}
    for t in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == t]
        for f, ok, key in (("region", lambda r: given(r[2]), trust), ("languages", lambda r: langs(r) > 0, lambda r: (langs(r), trust(r))), ("quality", lambda r: given(r[4]), trust),
                           ("revision", lambda r: given(r[5]), lambda r: (order[r[5]], trust(r)))):
            some = [r for r in own if ok(r)]
            if some and len(own) > 1:
                want[t, f] = max(some, key=key)[0]
    assert run(spark, rows) == want


def test_summed_votes(spark):
    rows = [(1, "a", "USA", None, "clean", None, D[0]), (2, "a", "Japan", None, "clean", None, D[0]), (3, "a", "japan ", None, "clean", None, D[0]), (4, "a", "Korea", None, None, None, None)]
    df = spark.createDataFrame([(*r, "f", "v", "t") for r in rows], SCHEMA)
    got = {r.field: (r.value, r.cand_id) for r in S.elect(df, "sum").collect()}
    assert got["region"] == ("japan", 2) and got["quality"] == ("clean", 1)
    record = S.surviving_records(df).collect()
    assert [(r.title, r.region, r.region_from, r.languages) for r in record] == [("a", "japan", 2, None)]
    assert S.elect(df.limit(0), "sum").count() == 0 and S.elect(df.limit(0), "strongest").count() == 0
