"""Encoding of a corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Words that one task remembers before it starts afresh, and bytes of a word that is not remembered.
WORDS_KEPT = 300_000
LONG_WORD = 256

#: Fixed value: the public pattern that splits text before merges; white space is Unicode's property.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    hidden = (b for b in range(256) if b not in set(plain))
    return letters | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class PrefixEncoder:
    """BPE encodings of words by a depth-first walk over the trie of their prefixes.

    The encoding of any prefix is its last token after the encoding of what comes
    before it, so one state per trie node, the last token, holds the encodings of all
    prefixes.  A token can be last if it ends the prefix and stays apart from the last
    token before it, which the merge ranks of the pair decide; exactly one can.
    Sorted words are the trie in depth-first order: the walk keeps the states of the
    current path and goes back to the prefix shared with the next word, so shared
    prefixes are encoded once and memory is one path.
    """

    def __init__(self, vocabulary: bytes) -> None:
        model = json.loads(vocabulary)["model"]
        letters = _byte_letters()

        def as_bytes(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.ids: dict[bytes, int] = {}
        for token, number in model["vocab"].items():
            if all(c in letters for c in token):
                self.ids[as_bytes(token)] = number
        self.size = {number: len(token) for token, number in self.ids.items()}
        self.longest = max(self.size.values())
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for order, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = self.ids[as_bytes(left)], self.ids[as_bytes(right)]
            whole = self.ids[as_bytes(left + right)]
            if whole not in self.halves:
                self.halves[whole], self.rank[whole] = (a, b), order
            self.merged[(a, b)] = whole
        self.apart = lru_cache(maxsize=400_000)(self._apart)

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging keeps a boundary between two tokens that were built on their own.

        The boundary is crossed if, at some point of both builds, the two tokens next
        to it merge earlier than either of them is built further.  Going back in time,
        the later of the two builds is undone first.
        """
        no_end = 1 << 60
        left_until = right_until = no_end
        while True:
            whole = self.merged.get((left, right))
            if whole is not None:
                at = self.rank[whole]
                if at < left_until and at <= right_until:
                    return False
            left_rank, right_rank = self.rank.get(left, -1), self.rank.get(right, -1)
            if left_rank < 0 and right_rank < 0:
                return True
            if left_rank > right_rank:
                left_until, left = left_rank, self.halves[left][1]
            else:
                right_until, right = right_rank, self.halves[right][0]

    def encode(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its token ids, in byte order."""
        last: list[int] = [0]
        before = b""
        ids, size, apart, longest = self.ids, self.size, self.apart, self.longest
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for length in range(min(end, longest), 0, -1):
                    token = ids.get(word[end - length : end])
                    if token is not None and (length == end or apart(last[end - length], token)):
                        last.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            found, end = [], len(word)
            while end:
                found.append(last[end])
                end -= size[last[end]]
            found.reverse()
            before = word
            yield word, found


def text_encoder(vocabulary: bytes) -> Callable[[str], list[int]]:
    """A function from text to token ids that remembers the words it met."""
    encoder, pattern = PrefixEncoder(vocabulary), regex.compile(WORD_PATTERN)
    known: dict[str, list[int]] = {}

    def learn(words: Iterable[str]) -> None:
        fresh = {w.encode("utf-8", "surrogatepass"): w for w in words}
        for coded, ids in encoder.encode(fresh):
            known[fresh[coded]] = ids

    def encode_all(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each begins."""
        if len(known) > WORDS_KEPT:
            known.clear()
        split = [pattern.findall(t) if t else [] for t in texts]
        learn({w for words in split for w in words if w not in known})
        starts, flat = [0], []
        for words in split:
            for word in words:
                flat += known[word]
            starts.append(len(flat))
        for word in {w for words in split for w in words if len(w) > LONG_WORD}:
            known.pop(word, None)
        return np.asarray(flat, dtype=np.int32), np.asarray(starts, dtype=np.int32)

    return encode_all


_ENCODERS: dict[int, Callable] = {}


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids array<int>``: token ids of each text, without special tokens.

    Null and empty texts have the empty list.  Strings of special tokens in a text are
    ordinary text.  Rows are encoded one by one as they stand: repeated rows and null
    keys stay, an empty table gives an empty result, other columns are not read.

    One map without a shuffle.  Each task gathers the distinct words of a slice of
    rows that it does not know yet, walks their prefix trie once and looks all words up
    in what it remembers (bounded by ``WORDS_KEPT``; longer words than ``LONG_WORD``
    are not kept).  The vocabulary, a file of fixed size, is read on the driver and
    broadcast, so executors need no path.
    """
    with open(vocabulary, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = shared.value
        encode = _ENCODERS.setdefault(hash(data), None) or text_encoder(data)
        _ENCODERS[hash(data)] = encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids, starts = encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(starts), pa.array(ids))], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
