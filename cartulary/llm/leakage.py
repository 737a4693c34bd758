"""Evaluation passages that leaked into a corpus: SimHash windows, Hamming blocks, shingle verification."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import LOOKALIKES
from cartulary.session import written

#: Words of a window, Hamming radius of its 64-bit fingerprint, and the bits of the blocks it is cut into:
#: of five blocks two are equal whatever three bits differ, so ten pairs of blocks index all within the radius.
WINDOW, RADIUS = 8, 3
BLOCKS = (13, 13, 13, 13, 12)
#: Share of a passage that must be found, and what makes a stretch: words, share found, widest gap and drift in words.
LEAST_SHARE, LEAST_STRETCH, LEAST_DENSITY = 1 / 3, 12, 0.35
GAP, DRIFT = 9, 5
SHINGLE = 2
#: Shingles of items that a run of a text, and a window of it, must have to be looked at: fewer make neither a stretch nor a near window.
LEAST_HITS = 3
#: Bits of the filter of item shingles: so many for each of them, within these bounds (32 MB at most).
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 64, 16, 28
#: A window of more passages than the first is hot, a shingle of more than the second is common: see ``Passages``.
HOT, COMMON = 100, 4
#: Shingles of all passages up to which they are broadcast (16 MB); those of longer lists are joined.
LIGHT = 1 << 20
#: Texts read at once, windows fingerprinted at once, words whose signs a task remembers, and shingles bounded at once.
TEXTS, CHUNK, WORDS_KEPT, BOUNDED = 500, 50_000, 200_000, 300_000

_TAG = regex.compile(r"</?[A-Za-z][^<>]*>|<[!?][^<>]*>")
_BROKEN = regex.compile(r"(?<=\p{L})-[ \t]*\r?\n[ \t>|*#:]*(?=\p{Ll})")
_JOINED = regex.compile(r"(?<=\p{L})['’‘`´](?=\p{L})")
_WORD = re.compile(r"[^\W_]+")
_FOLD = str.maketrans({letter: base for letter, base in LOOKALIKES.items()})


def normal_words(text: str | None) -> list[str]:
    """Words of a text without markup, case, accents, signs, lookalike letters and line breaks inside words."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    text = _JOINED.sub("", _BROKEN.sub("", text))
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and c not in "­​‌‍﻿")
        text = text.casefold().translate(_FOLD)
    return _WORD.findall(text.lower())


# -- fingerprints -----------------------------------------------------------------


class Words:
    """Hashes of words, and their 64 signs (+1, -1) times the word's weight, for as many words as a task remembers."""

    def __init__(self, weights: dict[str, int]) -> None:
        self.weights = weights
        self.place: dict[str, int] = {}
        self.signs = np.zeros((1024, 64), dtype=np.int8)
        self.hashes = np.zeros(1024, dtype=np.uint64)

    def of(self, words: list[str]) -> np.ndarray:
        """The places of the words in ``signs`` and ``hashes``."""
        if len(self.place) > WORDS_KEPT:
            self.place.clear()
        for word in set(words).difference(self.place):
            at = len(self.place)
            if at == len(self.hashes):
                self.signs = np.concatenate([self.signs, np.zeros_like(self.signs)])
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            digest = np.frombuffer(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint8)
            self.signs[at] = (np.unpackbits(digest).astype(np.int8) * 2 - 1) * self.weights.get(word, 3)
            self.hashes[at] = digest.view(np.uint64)[0]
            self.place[word] = at
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """A 64-bit number for each two words that follow each other."""
        h = self.hashes[at]
        x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    def prints(self, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """SimHash of the windows that begin at ``starts``."""
        out = []
        for lo in range(0, len(starts), CHUNK):
            some = starts[lo : lo + CHUNK]
            sums = np.zeros((len(some), 64), dtype=np.int8)  # eight words of weight three at most
            for k in range(WINDOW):
                sums += self.signs[at[some + k]]
            out.append(np.packbits(sums > 0, axis=1).view(np.uint64).ravel())
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def block_keys(prints: Column) -> Column:
    """The ten keys of a fingerprint: each pair of its blocks with the pair's number."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = lambda i: F.shiftrightunsigned(prints, starts[i]).bitwiseAND((1 << BLOCKS[i]) - 1)
    keys = [F.lit(no << 26) + block(a) * (1 << 13) + block(b) for no, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2))]
    return F.array(*keys)


def near_prints(left: DataFrame, right: DataFrame) -> DataFrame:
    """``p, q``: the fingerprints of ``left`` (``p``) and ``right`` (``q``), both distinct, within the radius.

    Each fingerprint is ten rows of the join, which the planner cannot foresee, so neither
    side may be broadcast on its estimate.
    """
    by = [df.select(c, F.explode(block_keys(F.col(c))).alias("k")).hint("merge") for df, c in ((left, "p"), (right, "q"))]
    return by[0].join(by[1], "k").where(F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= RADIUS).select("p", "q").distinct()


# -- items ------------------------------------------------------------------------


def _read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pa.array([normal_words(body) for body in batch.column(1).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), words], ["item", "words"])


def _coder(weights: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Words(weights)
        for batch in batches:
            rows = []
            for words in batch.column(1).to_pylist():
                at = maker.of(words)
                pairs = maker.pairs(at) if len(at) > 1 else np.zeros(0, np.uint64)
                rows.append((len(at), pairs.view(np.int64), maker.prints(at, np.arange(max(0, len(at) - WINDOW + 1))).view(np.int64)))
            n, pairs, prints = zip(*rows)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(pairs, longs), pa.array(prints, longs)], ["seq", "n", "pairs", "prints"])

    return run


def _rare_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``seq, pair`` for passages whose common shingles alone reach no leak."""
    for batch in batches:
        own, weights = batch.column(1), batch.column(2).values.to_numpy()[batch.column(2).offsets[0].as_py() : batch.column(2).offsets[-1].as_py()]
        sizes = np.diff(own.offsets.to_numpy())
        rare = weights > 1 / (COMMON + 0.5)
        rare &= np.repeat(~reached(sizes, weights, ~rare), sizes)
        seq = np.repeat(batch.column(0).to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(seq[rare]), own.flatten().filter(pa.array(rare))], ["seq", "pair"])


class Passages:
    """The distinct passages as tables: words of items, shingles with weights, fingerprints of windows."""

    def __init__(self, items: DataFrame) -> None:
        """``items``: ``item, passage``.  Nothing but word weights and the shingle filter, both bounded, reaches the driver."""
        kind = items.schema["item"].dataType.simpleString()
        read = written(items.where(F.length("passage") > 0).mapInArrow(_read_items, f"item {kind}, words array<string>").where(F.size("words") > 1))
        read = read.withColumn("seq", F.xxhash64("words"))
        #: ``seq, item``: the items of each distinct passage.
        self.items = read.select("seq", "item")
        known = read.dropDuplicates(["seq"]).select("seq", "words")
        count, words = known.select(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
        self.light = words <= LIGHT
        # A word of many passages says little about any; there are at most twelve times the mean number of distinct words of a passage.
        spread = known.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count().where(F.col("count") > count // 12)
        self.weights = {r["word"]: 1 if r["count"] > count // 3 else 2 for r in spread.collect()}
        coded = written(known.mapInArrow(_coder(self.weights), "seq bigint, n bigint, pairs array<bigint>, prints array<bigint>"))
        shared = written(coded.select(F.explode(F.array_distinct("pairs")).alias("pair")).groupBy("pair").agg(F.count("*").alias("passages")))
        placed = coded.select("seq", F.posexplode("pairs").alias("at", "pair")).join(shared, "pair")
        gathered = placed.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("at", "pair", (F.lit(1.0) / F.col("passages")).alias("w")))).alias("g"))
        #: ``seq, own array<bigint>, own_weights array<double>``: shingles in the order of the passage; one of several passages weighs less.
        self.shingles = gathered.select("seq", F.transform("g", lambda x: x["pair"]).alias("own"), F.transform("g", lambda x: x["w"]).alias("own_weights"))
        #: ``seq, q``: the passages that a window points to.
        self.windows = coded.select("seq", F.explode(F.array_distinct("prints")).alias("q"))
        #: ``q``: fingerprints of all windows.
        self.prints = self.windows.select("q").distinct()
        #: ``q``: hot windows, if there are any.  They do not point to the passages of ``rare``.
        self.hot = written(self.windows.groupBy("q").agg(F.count("*").alias("passages")).where(F.col("passages") > HOT).select("q"))
        self.any_hot = bool(self.hot.head(1))
        if self.any_hot:
            held = self.windows.join(self.hot, "q", "left_semi")
            #: ``seq, pair``: rare shingles of the passages with hot windows that cannot leak without one.
            self.rare = written(self.shingles.join(held.select("seq"), "seq", "left_semi").mapInArrow(_rare_shingles, "seq bigint, pair bigint"))
            spared = held.join(self.rare.select("seq"), "seq", "left_semi")
            self.windows = written(self.windows.join(spared, ["seq", "q"], "left_anti"))
        self.filter = self._filter(shared)

    @staticmethod
    def _filter(shared: DataFrame) -> tuple[int, np.ndarray]:
        """``(bits, words)``: a bit set for the leading bits of every shingle; false hits cost time, never results."""
        bits = min(max((shared.count() * FILTER_BITS).bit_length(), FILTER_LEAST), FILTER_MOST)
        place = F.shiftrightunsigned("pair", 64 - bits)
        rows = shared.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(pair, {64 - bits}) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word")).toPandas()
        words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        if len(rows):
            words[rows["at"].to_numpy()] = rows["word"].to_numpy(np.int64).view(np.uint64)
        return bits, words


# -- texts ------------------------------------------------------------------------


def scan_texts(maker: Words, bits: int, words: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """What texts share with any item: ``(text numbers, places, shingles, fingerprints)`` of the texts that have a window to look at.

    Shingles outside the filter belong to no item.  The others count in runs without a
    wider gap than a stretch can have; windows of enough of them are fingerprinted.
    """
    lists = [normal_words(t) for t in texts]
    flat = [w for own in lists for w in own]
    none = np.zeros(0, np.int64), [], [], []
    if len(flat) < WINDOW:
        return none
    sizes = np.array([len(own) for own in lists])
    text = np.repeat(np.arange(len(lists)), sizes)
    begin = np.cumsum(sizes) - sizes
    at = maker.of(flat)
    pair = maker.pairs(at)
    place = pair >> np.uint64(64 - bits)
    hit = (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    hits = np.flatnonzero(hit & (text[:-1] == text[1:]))
    if not len(hits):
        return none
    fresh = np.append(True, (np.diff(hits) > GAP) | (text[hits[1:]] != text[hits[:-1]]))
    run = np.cumsum(fresh) - 1
    hits = hits[np.bincount(run)[run] >= LEAST_HITS]
    before = np.zeros(len(flat) + 1, dtype=np.int32)
    before[hits + 1] = 1
    np.cumsum(before, out=before)
    starts = np.arange(len(flat) - WINDOW + 1)
    enough = before[starts + WINDOW - 1] - before[starts] >= LEAST_HITS
    starts = starts[enough & (text[starts] == text[starts + WINDOW - 1])]
    prints = maker.prints(at, starts)
    numbers, first = np.unique(text[starts], return_index=True)
    last = np.append(first[1:], len(starts))
    lo, hi = np.searchsorted(text[hits], numbers, "left"), np.searchsorted(text[hits], numbers, "right")
    return (
        numbers, [hits[a:b] - begin[n] for n, a, b in zip(numbers, lo, hi)], [pair[hits[a:b]].view(np.int64) for a, b in zip(lo, hi)],
        [np.unique(prints[a:b]).view(np.int64) for a, b in zip(first, last)],
    )


def share(own: np.ndarray, weights: np.ndarray, places: np.ndarray, pairs: np.ndarray) -> float:
    """Share of a passage's words that a text has in stretches of its wording and order.

    ``own, weights``: the passage's shingles; ``places, pairs``: those of the text.
    Shingles of both that follow each other with small gaps and little drift form a
    stretch.  A stretch counts if it is long and if the found shingles make up
    enough of its weight: one that several passages share weighs less.
    """
    n = len(own) + SHINGLE - 1
    # Stretches lie inside runs of found places, so what the runs span bounds what they can cover.
    found = np.flatnonzero(np.isin(own, pairs))
    if not len(found):
        return 0.0
    ends = np.flatnonzero(np.append(np.diff(found) > GAP, True))
    spans = found[ends] - found[np.append(0, ends[:-1] + 1)] + SHINGLE
    if spans[spans >= LEAST_STRETCH].sum() < LEAST_SHARE * n:
        return 0.0
    mine: dict[int, list[int]] = defaultdict(list)
    for i, pair in zip(found.tolist(), own[found].tolist()):
        mine[pair].append(i)
    theirs: dict[int, list[int]] = defaultdict(list)
    for j, pair in zip(places.tolist(), pairs.tolist()):
        if pair in mine:
            theirs[pair].append(j)
    stretches: list[list] = []  # last place in the passage and in the text, first place, places found
    active: list[list] = []
    for j, i in sorted((j, i) for pair, at in theirs.items() for i in mine[pair] for j in at):
        active = [s for s in active if j - s[1] <= GAP]
        best = None
        for s in active:
            di, dj = i - s[0], j - s[1]
            if 0 < di <= GAP and 0 < dj and abs(di - dj) <= DRIFT and (best is None or abs(di - dj) < best[0]):
                best = (abs(di - dj), s)
        if best is None:
            new = [i, j, i, [i]]
            active.append(new)
            stretches.append(new)
        else:
            best[1][0], best[1][1] = i, j
            best[1][3].append(i)
    covered = np.zeros(n, dtype=bool)
    for last, _, first, at in stretches:
        if last + SHINGLE - first < LEAST_STRETCH:
            continue
        # Weighted similarity of the stretch: what of its shingles is found, shared ones counting less.
        if weights[sorted(set(at))].sum() >= LEAST_DENSITY * weights[first : last + 1].sum():
            covered[first : last + SHINGLE] = True
    return float(covered.mean())


def possible(sizes: np.ndarray, own: np.ndarray, weights: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which of many pairs of passage and text can reach ``LEAST_SHARE``, all at once.

    ``own, weights``: the shingles of all passages, ``sizes`` of them each; ``pairs``: those of
    the texts, ``counts`` each.  Membership is read off a table of hashes, whose false hits
    only raise the bound.
    """
    row, no = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(counts)), counts)
    bits = min(max((len(pairs) * 32).bit_length(), 10), 24)
    place = lambda x, r: ((x.view(np.uint64) + r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, dtype=bool)
    table[place(pairs, no)] = True
    return reached(sizes, weights, table[place(own, row)])


def reached(sizes: np.ndarray, weights: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Which of many passages can reach ``LEAST_SHARE`` if these of their places are found: a bound never below ``share``.

    A stretch is an interval of a run of found places in which the found ones have
    ``LEAST_DENSITY`` of the weight; what no such interval covers, none does.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    least = LEAST_SHARE * (sizes + SHINGLE - 1) - 1e-9
    found = np.flatnonzero(hit)
    none = np.zeros(len(sizes), dtype=bool)
    if not len(found):
        return none
    fresh = np.append(True, (np.diff(found) > GAP) | (np.diff(row[found]) != 0))
    first, last = found[fresh], found[np.append(fresh[1:], True)]
    spans = last - first + SHINGLE
    spans[spans < LEAST_STRETCH] = 0
    enough = np.bincount(row[first], spans, len(sizes)) >= least
    kept = (spans > 0) & enough[row[first]]
    if not kept.any():
        return none
    first, length = first[kept], last[kept] - first[kept] + 1
    run = np.repeat(np.arange(len(first)), length)
    at = np.arange(len(run)) + np.repeat(first - (np.cumsum(length) - length), length)
    gain = weights[at] * (hit[at] - LEAST_DENSITY)
    after = np.cumsum(gain)
    # Each run lies below the one before it, so running extremes never leave it.
    down = run * (np.ptp(after) + np.ptp(gain) + 1)
    lowest = np.minimum.accumulate(after - gain - down)
    highest = np.maximum.accumulate((after - down)[::-1])[::-1]
    heavy = np.flatnonzero(highest - lowest >= -1e-6)
    if not len(heavy):
        return none
    fresh = np.append(True, (np.diff(heavy) > 1) | (np.diff(run[heavy]) != 0))
    first, last = heavy[fresh], heavy[np.append(fresh[1:], True)]
    spans = last - first + SHINGLE
    spans[spans < LEAST_STRETCH] = 0
    return np.bincount(row[at[first]], spans, len(sizes)) >= least


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passage: str = "passage") -> DataFrame:
    """``key, item_key, share``: every text that holds a third or more of an item's passage.

    Passages and texts are reduced to normal words.  All windows of eight words of the
    passages, and those of the texts that have enough word pairs of any passage (a filter
    of bounded size tells), get 64-bit SimHashes.  Ten pairs of five blocks of the
    fingerprints are the keys of an equi-join, so each passage window within Hamming
    radius three of a text's window is met, however many passages share it; where a window
    is hot and its passage cannot leak by common shingles alone, a text with that window
    meets the passage by any rare shingle of it.  Each pair of
    text and passage met is verified exactly: word shingles of both, weighted by the
    inverse of the number of passages that share them, are chained to stretches, and the
    stretches of length must cover ``LEAST_SHARE`` of the passage.  Phrases that items
    share, instructions and brief quotations do not reach that; a bound tells for many
    pairs at once which cannot.

    Null, empty and short texts and passages give no rows; items of equal passages are
    searched once; repeated item ids or texts give a row for each pair; very long texts
    are read whole.  The corpus is read and fingerprinted once, whatever the number of
    items, and is not shuffled: only what texts share with items is written to the
    checkpoint folder.  Joins are on fingerprint keys, texts and passages, all of which
    adaptive execution splits if they are hot.  What is used again is written as tables.
    """
    passages = Passages(items.select(F.col(item_key).alias("item"), F.col(passage).alias("passage")))
    bits, words = passages.filter
    context = documents.sparkSession.sparkContext
    filter_, weights = context.broadcast(words), passages.weights
    source = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.length("text") > 0).select(F.monotonically_increasing_id().alias("uid"), "doc", "text")
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((source, "doc"), (passages.items, "item")))
    longs = pa.list_(pa.int64())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, at = Words(weights), filter_.value
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                numbers, *found = scan_texts(maker, bits, at, part.column(2).to_pylist())
                if len(numbers):
                    kept = [part.column(c).take(pa.array(numbers)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, longs) for x in found)], ["uid", "doc", "places", "pairs", "prints"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in batch.columns[2:]]
            shares = np.zeros(batch.num_rows)
            total, lo = lists[0][0] + lists[3][0].astype(np.int64), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + BOUNDED, "right")) - 1)
                bounds = [at[lo : hi + 1] for at, _ in lists]
                own, weights, _, pairs = (values[at[0] : at[-1]] for at, (_, values) in zip(bounds, lists))
                for r in lo + np.flatnonzero(possible(np.diff(bounds[0]), own, weights, np.diff(bounds[3]), pairs)):
                    shares[r] = share(*(values[at[r] : at[r + 1]] for at, values in lists))
                lo = hi
            leaks = np.flatnonzero(shares >= LEAST_SHARE)
            if len(leaks):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(leaks)), batch.column(1).take(pa.array(leaks)), pa.array(shares[leaks])], ["doc", "seq", "share"])

    scanned = written(source.mapInArrow(scan, f"uid bigint, doc {kind}, places array<bigint>, pairs array<bigint>, prints array<bigint>"))
    own = scanned.select("uid", F.explode("prints").alias("p"))
    near = near_prints(own.select("p").distinct(), passages.prints)
    found = own.join(near, "p").select("uid", "q")
    if passages.any_hot:
        found = written(found)
    met = found.join(passages.windows, "q").select("uid", "seq")
    if passages.any_hot:
        shingled = scanned.join(found.join(passages.hot, "q", "left_semi").select("uid").distinct(), "uid", "left_semi").select("uid", F.explode(F.array_distinct("pairs")).alias("pair")).hint("merge")
        met = met.unionByName(shingled.join(passages.rare, "pair").select("uid", "seq"))
    met = met.distinct()
    shingles = F.broadcast(passages.shingles) if passages.light else passages.shingles
    sides = met.join(scanned.select("uid", "doc", "places", "pairs"), "uid").join(shingles, "seq").select("doc", "seq", "own", "own_weights", "places", "pairs")
    leaks = sides.mapInArrow(verify, f"doc {kind}, seq bigint, share double")
    return leaks.join(passages.items, "seq").select(F.col("doc").alias(key), F.col("item").alias(item_key), "share")
