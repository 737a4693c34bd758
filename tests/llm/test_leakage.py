from __future__ import annotations

import random

import numpy as np

from cartulary.llm import leakage as L

BANK = [f"{a} {b} {c}" for a in ("under the lamp", "with great care", "before the flood", "at noon", "by the old mill") for b in ("a tall clerk", "the seventh intern", "our glazier", "some auctioneer") for c in ("sold two maps", "lost every receipt", "kept a diary", "named the ship")]


def passage(rng, n=9):
    return ". ".join(f"{rng.choice(BANK)} near shelf {rng.randrange(9999)} of {''.join(rng.choices('abcdefgh', k=6))}" for _ in range(n))


def filler(rng, n):
    return " ".join("".join(rng.choices("klmnopqrst", k=rng.randint(2, 8))) for _ in range(n))


def damage(rng, text):
    words = text.split()
    for k in range(4, len(words), 9):
        words[k] = rng.choice([words[k].upper(), words[k] + "x", "really", words[k][:-1]])
    return "  ".join(words).replace(".", " -")


def test_leaks_found_and_quotations_not(spark):
    rng = random.Random(9)
    items = [(i, passage(rng), "Read the passage and answer the question below.") for i in range(60)]
    docs, want = [], set()
    for d in range(240):
        kind, (i, body, _) = d % 6, items[d % 60]
        words = body.split()
        part = {0: body, 1: damage(rng, body), 2: " ".join(words[10 : 10 + len(words) // 2]), 3: " ".join(words[: len(words) // 6]), 4: "Read the passage and answer the question below.", 5: " ".join(rng.choice(BANK) for _ in range(12))}[kind]
        docs.append((d, f"{filler(rng, 80)} {part} {filler(rng, 60)}", 7))
        if kind <= 2:
            want.add((d, i))
    docs += [(1000, None, 7), (1001, "", 7), (1002, "one two", 7), (1003, filler(rng, 60_000) + " " + items[3][1] + " " + filler(rng, 60_000), 7), (None, items[4][1], 7), (1004, "<p>" + items[5][1].replace(" ", "&nbsp;<b> </b>") + "</p>", 7)]
    want |= {(1003, 3), (None, 4), (1004, 5)}
    docs += [docs[0]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id bigint")
    table = spark.createDataFrame([*items, (61, None, ""), (62, "", ""), (63, "too short", "")], "item_id bigint, passage string, instruction string")
    got = L.leaked_items(df.drop("item_id"), table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) + 1
    twice = table.unionByName(table.where("item_id = 3").selectExpr("300 + item_id AS item_id", "passage", "instruction"))
    again = {(r.doc_id, r.item_id) for r in L.leaked_items(df.drop("item_id"), twice).collect()}
    assert again == want | {(d, 303) for d, i in want if i == 3}
    assert L.leaked_items(df.drop("item_id").limit(0), table).count() == 0
    assert L.leaked_items(df.drop("item_id"), table.limit(0)).count() == 0


def test_blocks_meet_all_within_radius(spark):
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**64, 400, dtype=np.uint64)
    near = prints.copy()
    for k in range(400):
        for bit in rng.choice(64, size=k % 6, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    left, right = (spark.createDataFrame([(int(x),) for x in a.view(np.int64)], f"{c} bigint") for a, c in ((near, "p"), (prints, "q")))
    got = {(r.p, r.q) for r in L.near_prints(left, right).collect()}
    brute = {(int(a.view(np.int64)), int(b.view(np.int64))) for a in near for b in prints if int(a ^ b).bit_count() <= L.RADIUS}
    assert got == brute and len(brute) >= 260


def test_expressions_of_many_items_point_to_none(spark):
    rng = random.Random(2)
    common = passage(rng, 3)
    items = [(i, f"{filler(rng, 70)} {common} {filler(rng, 70)}") for i in range(40)]
    docs = [(0, f"{filler(rng, 50)} {common} {filler(rng, 50)}"), (1, items[7][1]), (2, " ".join(items[9][1].split()[:120]))]
    got = L.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (2, 9)}


def test_filter_has_every_shingle_and_a_bound(spark):
    pairs = np.random.default_rng(4).integers(0, 2**64, 3_000, dtype=np.uint64)
    bits, words = L.Passages._filter(spark.createDataFrame([(int(x),) for x in pairs.view(np.int64)], "pair bigint"))
    place = pairs >> np.uint64(64 - bits)
    assert bits <= L.FILTER_MOST and ((words[(place >> np.uint64(6)).astype(int)] >> (place & np.uint64(63))) & np.uint64(1)).all()


def test_normal_words():
    assert L.normal_words("The publisher's “soft-spoken” cata-\n| logue, Café &amp; <b>pаper</b>") == ["the", "publishers", "soft", "spoken", "catalogue", "cafe", "paper"]


def test_stretches_of_many_passages_are_found(spark):
    rng = random.Random(5)
    common = filler(rng, 60)
    items = [(i, f"{common} {filler(rng, 50)}") for i in range(12)]
    docs = [(0, f"{filler(rng, 50)} {common} {filler(rng, 50)}"), (1, f"{filler(rng, 50)} {' '.join(common.split()[:20])} {filler(rng, 50)}")]
    got = L.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, i) for i in range(12)} and len(got) == 12


def test_lists_of_any_length_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, passage(rng)) for i in range(30)]
    docs = [(d, f"{filler(rng, 30)} {damage(rng, items[d % 30][1])}") for d in range(60)]
    tables = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    light = {tuple(r) for r in L.leaked_items(*tables).collect()}
    monkeypatch.setattr(L, "LIGHT", 0)
    assert {tuple(r) for r in L.leaked_items(*tables).collect()} == light and {r[:2] for r in light} >= {(d, d % 30) for d in range(60)}


def test_bound_is_never_below_the_share():
    rng = np.random.default_rng(8)
    pairs = rng.integers(-(2**63), 2**63 - 1, 60)
    cases = []
    for _ in range(3_000):
        own = rng.choice(pairs, rng.integers(1, 70))
        weights = 1.0 / rng.integers(1, rng.choice([2, 5, 40]), len(own))
        theirs = np.where(rng.random(len(own)) < rng.random(), own, rng.integers(0, 2**62, len(own)))[rng.integers(0, len(own)) :]
        theirs = np.concatenate([theirs, rng.choice(pairs, rng.integers(0, 9))])
        cases.append((own, weights, np.arange(len(theirs)) * rng.integers(1, 3), theirs))
    shares = np.array([L.share(*c) for c in cases])
    column = lambda k: np.concatenate([c[k] for c in cases])
    got = L.possible(np.array([len(c[0]) for c in cases]), column(0), column(1), np.array([len(c[3]) for c in cases]), column(3))
    assert got[shares >= L.LEAST_SHARE].all() and (shares >= L.LEAST_SHARE).sum() > 100 and not got.all()


def test_hot_windows_meet_all_they_must(spark, monkeypatch):
    rng = random.Random(7)
    common, half = filler(rng, 30), filler(rng, 60)
    items = [(i, f"{filler(rng, 45)} {common} {filler(rng, 45)}") for i in range(20)] + [(i, f"{half} {filler(rng, 50)}") for i in range(20, 32)]
    worn = " ".join(w if 45 <= k < 75 or k % 4 else "word" for k, w in enumerate(items[5][1].split()))
    docs = [(d, f"{filler(rng, 20)} {body} {filler(rng, 20)}") for d, body in enumerate([common, half, f"{common} {half}", items[3][1], " ".join(items[4][1].split()[50:115]), items[25][1], " ".join(items[26][1].split()[60:]), worn])]
    tables = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    plain = {tuple(r) for r in L.leaked_items(*tables).collect()}
    assert {r[:2] for r in plain} == {(d, i) for d in (1, 2, 5) for i in range(20, 32)} | {(3, 3), (4, 4), (6, 26), (7, 5)}
    monkeypatch.setattr(L, "HOT", 5)
    passages = L.Passages(tables[1].selectExpr("item_id item", "passage"))
    assert passages.windows.join(passages.hot, "q").select("seq").distinct().count() == 12 and passages.rare.select("seq").distinct().count() == 20
    assert {tuple(r) for r in L.leaked_items(*tables).collect()} == plain
