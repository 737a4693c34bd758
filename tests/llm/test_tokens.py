from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tokenizers")
from cartulary.llm import tokens as T  # noqa: E402


@pytest.fixture(scope="module")
def encode():
    with open(T.VOCABULARY, "rb") as file:
        return T.text_encoder(file.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(T.VOCABULARY)
    tokenizer.encode_special_tokens = True
    return tokenizer


def ids_of(encode, texts):
    ids, starts = encode(texts)
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]


def test_against_library(encode, library):
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x250)] + [chr(c) for c in range(0x2000, 0x2070)] + list("日本語กี😀👩‍🚀'sre   \n\t") + list("etaoin shrdlu" * 20)
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(3_000)]
    texts += ["<|endoftext|> is text", "a" * 3_000, " " * 500, "ab" * 2_000, "\n" * 99, "don't 12345  x"]
    assert ids_of(encode, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)))
def test_round_trip(encode, library, text):
    ids = ids_of(encode, [text])[0]
    assert library.decode(ids, skip_special_tokens=False) == text


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "hello world", "z"), (3, "hello world", "z"), (None, "hi", None), (5, "word " * 100_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = T.encode_documents(df).collect()
    assert len(got) == 6 and [r.ids for r in got if r.doc_id in (1, 2)] == [[], []]
    assert [r.ids for r in got if r.doc_id == 3] == [[31373, 995]] * 2
    assert len(next(r.ids for r in got if r.doc_id == 5)) == 100_001
    assert T.encode_documents(df.limit(0)).count() == 0


def test_memory_is_bounded(encode, monkeypatch):
    monkeypatch.setattr(T, "WORDS_KEPT", 10)
    texts = [f"word{i} {'x' * 300}{i}" for i in range(50)]
    assert ids_of(encode, texts[:25]) + ids_of(encode, texts[25:]) == ids_of(encode, texts)
