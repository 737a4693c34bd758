"""Reading level of each document by a familiar-word formula."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Document shares from which a word can count as familiar; the best on the samples is taken.
FAMILIAR_SHARES = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)
#: Labelled samples that the level model is fitted on at most.
MAX_SAMPLES = 5_000
#: Words below which a piece is no sentence, and the share of the pooled spread in that of a level.
LEAST_SENTENCE, POOLED = 3, 0.1

_SENTENCE_END = r"(?<=[.!?])[\"')\]]*\s+|\s*\n\s*\n\s*"
_WORD = r"\p{L}+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0)


def document_shares(documents: DataFrame, text: str = "text", least: float = FAMILIAR_SHARES[0]) -> dict[str, float]:
    """Words of at least ``least`` of all documents, with the share of documents that have them.

    A document has a mean number of distinct words, so no more than that mean divided by
    ``least`` words can come out: the list does not grow with the corpus.
    """
    texts = documents.select(text).where(F.col(text).isNotNull())
    counted = texts.select(F.explode(F.array_distinct(F.concat(words_of(F.col(text)), F.array(F.lit(""))))).alias("word")).groupBy("word").count()
    # The empty word stands in every document, so its count is the number of documents.
    total = counted.where(F.col("word") == "").agg(F.coalesce(F.max("count"), F.lit(0)).alias("total"))
    rows = counted.join(F.broadcast(total), (F.col("count") >= F.col("total") * least) & (F.col("word") != "")).collect()
    return {r["word"]: r["count"] / r["total"] for r in rows}


def piece_words(text: Column) -> Column:
    """Words of each piece of a text: sentences, headings, list items; all words of the text are in one of them."""
    return F.transform(F.split(text, _SENTENCE_END), words_of)


def unfamiliar_share(familiar: list[str]) -> Column:
    """Share of all words of the column ``pieces`` that are outside the familiar list; 0 without words.

    Words are letters only; the list is planned as a hashed set.
    """
    words = F.size(F.flatten("pieces"))
    inside = F.expr(f"size(filter(flatten(pieces), w -> w IN ({', '.join(repr(w) for w in familiar)})))") if familiar else F.lit(0)
    return F.when(words > 0, (words - inside) / words).otherwise(0.0)


def log_sentence_length() -> Column:
    """Logarithm of the average number of words in a sentence of ``pieces``; pieces below three words are none; 0 without sentences."""
    sizes = F.filter(F.transform("pieces", F.size), lambda n: n >= LEAST_SENTENCE)
    return F.when(F.size(sizes) > 0, F.log(F.aggregate(sizes, F.lit(0), lambda a, n: a + n) / F.size(sizes))).otherwise(0.0)


@dataclass
class LevelModel:
    """A normal spread of (unfamiliar share, log sentence length) for each level."""

    levels: list[int]
    means: np.ndarray
    inverses: np.ndarray
    offsets: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> LevelModel:
        levels = sorted(set(y.tolist()))
        spread = [np.atleast_2d(np.cov(x[y == v].T)) if (y == v).sum() > 2 else np.zeros((2, 2)) for v in levels]
        pooled = sum(spread) / len(spread) + 1e-6 * np.eye(2)
        mixed = [(1 - POOLED) * s + POOLED * pooled for s in spread]
        return cls(levels, np.array([x[y == v].mean(0) for v in levels]), np.array([np.linalg.inv(s) for s in mixed]),
                   np.array([-0.5 * np.log(np.linalg.det(s)) for s in mixed]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        d = x[:, None, :] - self.means[None]
        return self.offsets - 0.5 * np.einsum("nli,lij,nlj->nl", d, self.inverses, d)

    def level(self, share: Column, length: Column) -> Column:
        scored = []
        for v, mean, inverse, offset in zip(self.levels, self.means.tolist(), self.inverses.tolist(), self.offsets.tolist()):
            a, b = share - F.lit(mean[0]), length - F.lit(mean[1])
            far = a * a * inverse[0][0] + a * b * (inverse[0][1] + inverse[1][0]) + b * b * inverse[1][1]
            scored.append(F.struct((F.lit(offset) - far * 0.5).alias("score"), F.lit(-v).alias("v")))
        return (-F.array_max(F.array(*scored))["v"]).cast("bigint")


def left_out(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Accuracy and mean log-likelihood of each sample under the model of all others."""
    right, likely = 0, 0.0
    for i in range(len(y)):
        rest = np.arange(len(y)) != i
        model = LevelModel.fit(x[rest], y[rest])
        s = model.scores(x[i : i + 1])[0]
        right += model.levels[int(s.argmax())] == y[i]
        own = model.levels.index(int(y[i])) if int(y[i]) in model.levels else int(s.argmin())
        likely += s[own] - s.max() - np.log(np.exp(s - s.max()).sum())
    return right / len(y), likely / len(y)


def fit_levels(documents: DataFrame, samples: DataFrame, text: str = "text", label: str = "level") -> tuple[LevelModel, list[str], float]:
    """The level model, the familiar words, and the accuracy on samples left out."""
    shares = document_shares(documents, text)
    lists = [sorted(w for w, s in shares.items() if s >= cut) for cut in FAMILIAR_SHARES]
    prepared = samples.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(label).alias("label"), piece_words(F.col(text)).alias("pieces"), F.xxhash64(text).alias("h"))
    rows = (
        prepared.orderBy("h").limit(MAX_SAMPLES)
        .select("label", log_sentence_length().alias("length"), *[unfamiliar_share(familiar).alias(f"s{i}") for i, familiar in enumerate(lists)])
        .collect()
    )
    y = np.array([r["label"] for r in rows], dtype=int)
    if len(set(y.tolist())) < 2:
        raise ValueError("reading samples need at least two levels")
    best = None
    for i, familiar in enumerate(lists):
        x = np.array([[r[f"s{i}"], r["length"]] for r in rows], dtype=float)
        accuracy, likely = left_out(x, y)
        if best is None or (accuracy, likely) > best[:2]:
            best = (accuracy, likely, LevelModel.fit(x, y), familiar)
    return best[2], best[3], best[0]


def reading_levels(
    documents: DataFrame, corpus: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, level``: the reading level of each document, on the scale of the samples.

    The formula is that of familiar words: the share of all words of a text that are
    outside a list of high document frequency, plus the (logarithm of the) average
    sentence length.  The list is derived from ``corpus``, of which all documents are
    counted.  Where the list begins and which pairs of the two measures make a level
    is calibrated on the labelled samples, of which at most ``MAX_SAMPLES`` are used.
    Null texts have no level; a measure is 0 for texts without words or sentences.

    One shuffle, of words with their partial counts.  The word list is of bounded
    size and part of the plan as a hashed set; documents are scored inside the JVM.
    """
    model, familiar, _ = fit_levels(corpus, samples, text)
    prepared = documents.where(F.col(text).isNotNull()).select(F.col(key), piece_words(F.col(text)).alias("pieces"))
    measured = prepared.select(key, unfamiliar_share(familiar).alias("share"), log_sentence_length().alias("length"))
    return measured.select(key, model.level(F.col("share"), F.col("length")).alias("level"))
