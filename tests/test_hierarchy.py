from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cartulary.operators import hierarchy as H


def brute(links):
    up = dict(links)
    out = {}
    for node in up:
        path, at = [node], node
        while at in up and len(path) <= len(up) + 1:
            at = up[at]
            if at in path:
                path = None
                break
            path.append(at)
        out[node] = (-1, -1, None) if path is None else (path[-1], len(path) - 1, path[::-1])
    return out


def frame(spark, links, tree="t", grp=None):
    return spark.createDataFrame([(tree, grp if grp is not None else c % 7, c, p) for c, p in links.items()], "tree string, grp bigint, child bigint, parent bigint")


@pytest.mark.parametrize("per_task", [400_000, 40, 7])
def test_climb_matches_brute_force(spark, per_task):
    rng = random.Random(per_task)
    links = {i: rng.choice([i - 1, rng.randrange(400), i // 2]) for i in range(1, 300)}
    links |= {500: 501, 501: 502, 502: 500, 503: 502, 600: 600}  # cycles, a tail of one, a node of its own
    want = brute(links)
    got = {r.node: (r.root, r.depth, r.path) for r in H.climb(frame(spark, links), with_path=True, per_task=per_task).collect()}
    assert got == want
    plain = {r.node: (r.root, r.depth) for r in H.climb(frame(spark, links), per_task=per_task).collect()}
    assert plain == {k: v[:2] for k, v in want.items()}


def test_long_chain_and_cycle_over_many_partitions(spark):
    order = list(range(1, 801))
    random.Random(1).shuffle(order)  # no partition holds neighbours
    chain = {a: b for a, b in zip(order, order[1:])}
    ring = [10_000 + i for i in range(333)]
    random.Random(2).shuffle(ring)
    links = chain | {a: b for a, b in zip(ring, ring[1:] + ring[:1])}
    got = {r.node: (r.root, r.depth) for r in H.climb(frame(spark, links, grp=1), per_task=50).collect()}
    assert got == {k: v[:2] for k, v in brute(links).items()}


def test_descendants_and_empty(spark):
    links = {2: 1, 3: 2, 4: 2, 9: 9}
    below = {(r.ancestor, r.descendant, r.distance) for r in H.descendants(H.climb(frame(spark, links), with_path=True)).collect()}
    assert below == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 2), (2, 4, 1)}
    empty = spark.createDataFrame([], "tree string, grp bigint, child bigint, parent bigint")
    assert H.climb(empty, with_path=True).count() == 0


def test_entry_links_nulls_ties_and_removed(spark):
    entries = spark.createDataFrame(
        [(1, 1, "a", None, None, False), (2, 1, "b", "a", "a", False), (3, 1, "a", "", None, False), (4, None, "c", "a", None, False), (5, 1, "gone", None, None, True),
         (6, 1, "d", "gone", "d", False), (7, 1, None, "b", None, False)],
        "game_id bigint, dat_id bigint, name string, cloneof string, romof string, removed boolean")
    got = sorted((r.tree, r.child, r.parent) for r in H.entry_links(entries.withColumn("parent", F.lit("clash"))).collect())
    assert got == [("cloneof", 2, 1), ("cloneof", 7, 2), ("romof", 2, 1), ("romof", 6, 6)]
