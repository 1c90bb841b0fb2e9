"""Connected components by alternating stars, and links within groups of which not all pairs are formed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rillwise.store import discard, saved

#: Rows of a group up to which its pairs are formed; pairs of a larger one that are tried at a time.
PAIRED, TRIED = 200, 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Large: a node's larger neighbours move to its least neighbour; small: the others do, and the node with them.

    An edge's u is its larger end, so the small step needs each edge once, and its node as an edge to itself that moves too.
    """
    seen = [("u", "v"), ("v", "u")] if large else [("u", "v"), ("u", "u")]
    near = edges.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in seen])).alias("e")).select("e.*")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u")
    out = (moved.filter("v > u") if large else moved).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, component): the least node that each node of an undirected edge table can reach.

    Nodes without an edge are not returned. Loops and repeated edges don't matter; an edge with a null end is ignored.
    Rounds grow with the logarithm of the longest path; each round's edges are written to the shared folder.
    """
    u, v = F.col(src), F.col(dst)
    now = saved(edges.filter(u.isNotNull() & v.isNotNull()).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    nodes, now = now.filter("u = v").select("u"), now.filter("u <> v")
    mark, before = None, None
    while True:
        after = saved(_star(_star(now, large=True), large=False), "edges")
        if before is not None:
            discard(before)
        now = before = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    labelled = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = nodes.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return labelled.unionByName(roots).unionByName(alone.join(labelled.unionByName(roots).select("node"), "node", "left_anti"))


def _parted(n: int, meets: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of n things the first of those that it is linked with, directly or through others. meets tells which of some meet which of others.

    What is found isn't tried again: where most things meet, few of the pairs are tried.
    """
    first, left = np.arange(n), np.arange(n)
    while len(left):
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            some = max(1, TRIED // len(left))
            hit = meets(front[:some], left).any(axis=0)
            first[left[hit]] = root
            front, left = np.concatenate([front[some:], left[hit]]), left[~hit]
    return first


def group_links(rows: DataFrame, keys: list[str], node: str, columns: list[str], meets: Callable[[list[Column], list[Column]], Column], meets_all: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]) -> DataFrame:
    """(u, v): links between nodes of a group (equal keys) that join the same nodes as all pairs that meet would.

    meets and meets_all say the same of the columns of two rows, as expressions and as arrays. A group of more than PAIRED rows
    forms no pairs: it is searched as a whole, and its rows link to one for each part; its columns are what a task holds.
    """
    rows = saved(rows.select(*keys, F.col(node).alias("u"), *columns), "grouped")
    crowded = saved(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > PAIRED).drop("_n"), "crowded")
    few = rows.join(crowded, keys, "left_anti")
    other = few.select(*keys, F.col("u").alias("v"), *[F.col(c).alias(f"_{c}") for c in columns])
    pairs = few.join(other, keys).filter("u < v").filter(meets([F.col(c) for c in columns], [F.col(f"_{c}") for c in columns])).select("u", "v")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        own = [group[c].to_numpy() for c in columns]
        first = _parted(len(group), lambda a, b: meets_all([x[a][:, None] for x in own], [x[b][None] for x in own]))
        linked = first != np.arange(len(group))
        return pd.DataFrame({"u": group["u"].to_numpy()[linked], "v": group["u"].to_numpy()[first[linked]]})

    kind = rows.schema["u"].dataType.simpleString()
    return pairs.unionByName(rows.join(crowded, keys, "left_semi").groupBy(*keys).applyInPandas(search, f"u {kind}, v {kind}")).distinct()
