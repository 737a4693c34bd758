from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from cartulary.llm import reading as R

EASY = "the cat dog sat ran on mat big red sun hat and is my up we see it go in".split()
HARD = [f"{a}{b}ization" for a in ("epistem", "jurid", "metaphys", "hermen", "catal") for b in ("ologic", "ural", "etic", "og")]


def text(rng, level, n=25):
    out = []
    for _ in range(n):
        size, hard = {1: (5, 0.0), 2: (14, 0.05), 3: (14, 0.45), 4: (30, 0.5)}[level]
        out.append(" ".join(rng.choice(HARD) if rng.random() < hard else rng.choice(EASY) for _ in range(size + rng.randint(-1, 1))) + ".")
    return " ".join(out)


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(3)
    samples = spark.createDataFrame([(text(rng, v), v) for v in (1, 2, 3, 4) for _ in range(20)] + [(None, 1), ("x", None)], "text string, level int")
    docs = [(i, text(rng, 1 + i // 2 % 4 if i % 2 else 1), 9) for i in range(400)]
    docs += [(1000, None, 9), (1001, "", 9), (1002, "?? ...", 9), (1003, text(rng, 4, 4_000), 9), (None, text(rng, 2), 9), (0, docs[0][1], 9)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, level int")
    got = [(r.doc_id, r.level) for r in R.reading_levels(df, df, samples).collect()]
    truth = {i: (1 + i // 2 % 4 if i % 2 else 1) for i in range(400)}
    assert len(got) == 405 and all(v in (1, 2, 3, 4) for _, v in got)
    assert np.mean([truth[d] == v for d, v in got if d in truth]) > 0.97
    assert dict(got)[1003] == 4
    assert R.reading_levels(df.limit(0), df, samples).count() == 0


def test_document_shares_are_exact(spark):
    df = spark.createDataFrame([("A cat a",), ("a Dog",), (None,), ("",)], "text string")
    assert R.document_shares(df, least=0.0) == {"a": 2 / 3, "cat": 1 / 3, "dog": 1 / 3}
    assert R.document_shares(df.limit(0)) == {}


def test_sentences(spark):
    df = spark.createDataFrame([("# Head\n\nOne two three. Four five six seven!\n\n* item\n* item\n\nEight nine ten",)], "text string")
    assert [len(w) for w in df.select(R.piece_words(F.col("text")).alias("s")).first().s] == [1, 3, 4, 2, 3]
    row = df.select(R.piece_words(F.col("text")).alias("pieces")).select(R.log_sentence_length().alias("l"), R.unfamiliar_share(["head", "item"]).alias("u"), R.unfamiliar_share([]).alias("all")).first()
    assert np.isclose(row.l, np.log(10 / 3)) and np.isclose(row.u, 10 / 13) and row["all"] == 1.0
