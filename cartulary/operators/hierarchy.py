"""Parent-child links to full hierarchies by weighted disjoint-set forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.session import checkpointed

#: Links that one task takes into its forest (three 8-byte numbers each).
LINKS_PER_TASK = 50_000


class WeightedForest:
    """Disjoint sets of nodes, each node with its offset to the node it hangs below.

    Nodes are numbered from 0.  A link hangs a whole set below another node; one
    compression moves every node directly below its root and sums the offsets on
    the way.  Nodes whose climb never ends are told apart as ``looped``.
    """

    def __init__(self, size: int) -> None:
        self.up = np.arange(size, dtype=np.int64)
        self.offset = np.zeros(size, dtype=np.int64)
        self.linked = np.zeros(size, dtype=bool)

    def link(self, child: np.ndarray, parent: np.ndarray, weight: np.ndarray) -> None:
        self.up[child], self.offset[child], self.linked[child] = parent, weight, True

    def compress(self) -> np.ndarray:
        """Bring all nodes below their roots; the mask of nodes that have none."""
        for _ in range(len(self.up).bit_length() + 1):
            above = self.up[self.up]
            if np.array_equal(above, self.up):
                break
            self.offset = self.offset + self.offset[self.up]
            self.up = above
        return self.linked[self.up]


def _forest(links: pd.DataFrame) -> tuple[np.ndarray, WeightedForest, np.ndarray]:
    """Node ids, their forest before compression, and the place of each link's child."""
    ids, place = np.unique(np.concatenate([links["child"].to_numpy(), links["parent"].to_numpy()]), return_inverse=True)
    forest = WeightedForest(len(ids))
    at = place[: len(links)]
    forest.link(at, place[len(links):], links["weight"].to_numpy())
    return ids, forest, at


def _partition(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each child of a partition below the topmost node that the partition's links reach."""
    links = _partition(batches)
    if links.empty:
        return
    for tree, own in links.groupby("tree", sort=False):
        ids, forest, at = _forest(own)
        looped = forest.compress()
        yield pd.DataFrame({"tree": tree, "grp": own["grp"].to_numpy(), "child": own["child"].to_numpy(),
                            "top": ids[forest.up[at]], "distance": forest.offset[at], "looped": looped[at]})


def _contract_with_steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """As ``_contract``, with the nodes from the child up to, not including, the topmost one."""
    links = _partition(batches)
    if links.empty:
        return
    segments = links.get("steps")
    for tree, own in links.groupby("tree", sort=False):
        ids, forest, at = _forest(own)
        parent, own_steps = forest.up.copy(), {}
        if segments is not None:
            own_steps = dict(zip(at.tolist(), segments.loc[own.index]))
        looped = forest.compress()
        for lo in range(0, len(own), 20_000):
            here = at[lo : lo + 20_000]
            steps = []
            for node in here.tolist():
                path: list[int] = []
                if not looped[node]:
                    top = forest.up[node]
                    while node != top:
                        path.extend(own_steps[node] if own_steps else (ids[node],))
                        node = parent[node]
                steps.append(path)
            part = own.iloc[lo : lo + 20_000]
            yield pd.DataFrame({"tree": tree, "grp": part["grp"].to_numpy(), "child": part["child"].to_numpy(),
                                "top": ids[forest.up[here]], "distance": forest.offset[here],
                                "looped": looped[here], "steps": steps})


def _merge(links: DataFrame, with_steps: bool, per_task: int, rounds: int | None = None) -> DataFrame:
    """``tree, grp, child, top, distance, looped[, steps]`` for every link of a checkpointed table.

    Each round halves the links, or else the length of every chain, so after twice as
    many rounds as the number of all links has bits only cycles can be left.
    """
    size = links.count()
    rounds = 2 * size.bit_length() + 4 if rounds is None else rounds
    parts = max(1, -(-size // per_task))
    schema = "tree string, grp bigint, child bigint, top bigint, distance bigint, looped boolean"
    contract = _contract
    if with_steps:
        schema, contract = schema + ", steps array<bigint>", _contract_with_steps
    local = checkpointed(
        links.repartitionByRange(parts, "tree", "grp", "child").mapInPandas(contract, schema)
    )
    if parts == 1:
        return local
    steps = ["steps"] if with_steps else []
    tops = local.where(~F.col("looped")).select(F.col("tree").alias("t"), F.col("top").alias("n")).distinct()
    # A portal is a topmost node of some partition that itself has a parent elsewhere.
    portals = checkpointed(
        local.join(tops, (F.col("tree") == F.col("t")) & (F.col("child") == F.col("n")), "left_semi").select(
            "tree", "grp", "child", F.when(F.col("looped"), F.col("child")).otherwise(F.col("top")).alias("parent"),
            F.col("distance").alias("weight"), *steps))
    count = portals.count()
    if count == 0:
        return local
    if rounds <= 0:
        above = portals.select(F.col("tree").alias("u_tree"), F.col("child").alias("u_child"), F.lit(True).alias("u_loop"))
        return local.join(above, (F.col("tree") == F.col("u_tree")) & (F.col("top") == F.col("u_child")), "left").select(
            "tree", "grp", "child", "top", "distance", (F.col("looped") | F.coalesce("u_loop", F.lit(False))).alias("looped"), *steps)
    if count > size // 2:
        portals = checkpointed(_doubled(portals, with_steps))
    merged = _merge(portals, with_steps, per_task, rounds - 1).select(
        F.col("tree").alias("u_tree"), F.col("child").alias("u_child"), F.col("top").alias("u_top"),
        F.col("distance").alias("u_distance"), F.col("looped").alias("u_looped"),
        *([F.col("steps").alias("u_steps")] if with_steps else []))
    joined = local.join(merged, (F.col("tree") == F.col("u_tree")) & (F.col("top") == F.col("u_child")), "left")
    done = [
        "tree", "grp", "child", F.coalesce("u_top", "top").alias("top"),
        (F.col("distance") + F.coalesce("u_distance", F.lit(0))).alias("distance"),
        (F.col("looped") | F.coalesce("u_looped", F.lit(False))).alias("looped"),
    ]
    if with_steps:
        done.append(F.concat("steps", F.coalesce("u_steps", F.array().cast("array<bigint>"))).alias("steps"))
    return joined.select(*done)


def _doubled(portals: DataFrame, with_steps: bool) -> DataFrame:
    """Each link carried on over the link of its parent: half the chain, where partitions hold few of them."""
    nxt = portals.select(F.col("tree").alias("n_tree"), F.col("child").alias("n_child"), F.col("parent").alias("n_parent"),
                         F.col("weight").alias("n_weight"), *([F.col("steps").alias("n_steps")] if with_steps else []))
    joined = portals.join(nxt, (F.col("tree") == F.col("n_tree")) & (F.col("parent") == F.col("n_child")), "left")
    done = ["tree", "grp", "child", F.coalesce("n_parent", "parent").alias("parent"),
            (F.col("weight") + F.coalesce("n_weight", F.lit(0))).alias("weight")]
    if with_steps:
        done.append(F.concat("steps", F.coalesce("n_steps", F.array().cast("array<bigint>"))).alias("steps"))
    return joined.select(*done)


def climb(links: DataFrame, with_path: bool = False, per_task: int = LINKS_PER_TASK) -> DataFrame:
    """Root, depth and, if wanted, path of every node that has a parent.

    ``links``: ``tree string, grp bigint, child bigint, parent bigint``, at most one
    row for each ``(tree, child)``; ``grp`` brings nodes together that are likely to
    share a tree (the catalog).  Result: ``tree, node, root, depth``, and ``path``,
    the nodes from the root down to the node itself.  A climb that runs into a cycle
    never ends: root and depth are -1 and path is null.  Links without child or
    parent are left out; a node that is its own parent is a cycle; an empty table
    gives an empty result.

    Links are range-partitioned by group and child, and each partition combines its
    links in one weighted disjoint-set forest (offsets count links).  Topmost nodes
    that have a parent in another partition then form a smaller table of weighted
    links, which goes through the same step with fewer partitions, until one
    partition holds all: a hot group is just several partitions.  Where partitions
    share few chains, links are doubled by a join before the next round, so rounds
    grow with the logarithm of the longest chain and no task ever holds more than
    about ``per_task`` links.  Results flow back by one join per round on the
    topmost node.  Paths are read off an index of parents inside each partition and
    joined end to end.
    """
    base = links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).select(
        "tree", F.coalesce("grp", F.lit(0)).cast("bigint").alias("grp"), F.col("child").cast("bigint").alias("child"),
        F.col("parent").cast("bigint").alias("parent"), F.lit(1).cast("bigint").alias("weight"))
    done = _merge(checkpointed(base), with_path, per_task)
    result = [
        F.col("tree"), F.col("child").alias("node"),
        F.when(F.col("looped"), F.lit(-1)).otherwise(F.col("top")).cast("bigint").alias("root"),
        F.when(F.col("looped"), F.lit(-1)).otherwise(F.col("distance")).cast("bigint").alias("depth"),
    ]
    if with_path:
        result.append(F.when(~F.col("looped"), F.reverse(F.concat("steps", F.array("top")))).alias("path"))
    return done.select(*result)


def entry_links(entries: DataFrame) -> DataFrame:
    """The cloneof and romof links between entries in force, as input for ``climb``.

    The parent is the entry of the same catalog, not removed, whose name equals the
    reference as written; where several bear the name, the one with the smallest id.
    References are joined on catalog and name, so a hot catalog spreads over all tasks.
    """
    live = entries.where(~F.col("removed"))
    named = (
        live.where(F.col("name").isNotNull() & F.col("dat_id").isNotNull())
        .groupBy(F.col("dat_id").alias("p_dat"), F.col("name").alias("p_name"))
        .agg(F.min("game_id").alias("parent"))
    )
    children = live.select(
        "dat_id", "game_id",
        F.inline(F.filter(F.array(F.struct(F.lit("cloneof").alias("tree"), F.col("cloneof").alias("ref")),
                                  F.struct(F.lit("romof").alias("tree"), F.col("romof").alias("ref"))),
                          lambda x: x["ref"].isNotNull())))
    return children.join(named, (F.col("dat_id") == F.col("p_dat")) & (F.col("ref") == F.col("p_name"))).select(
        "tree", F.col("dat_id").alias("grp"), F.col("game_id").alias("child"), "parent"
    )


def descendants(paths: DataFrame) -> DataFrame:
    """``tree, ancestor, descendant, distance``: a row for each node below each node, from ``climb`` with paths."""
    return paths.where(F.col("path").isNotNull()).select(
        "tree", F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor")
    ).select("tree", "ancestor", "descendant", (F.col("depth") - F.col("at")).cast("bigint").alias("distance"))
