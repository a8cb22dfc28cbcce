"""Connected components of an edge table, by alternating large-star and small-star steps; places along paths, by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.durable import stash

SMALL = 20_000  # rows of a graph that is closed, or a set of paths that is ranked, in one task


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _closed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A small graph's components: later roots hook to earlier ones, then all point at roots."""
    edges = pd.concat([*parts, pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})])
    names, at = np.unique(edges[["u", "v"]].to_numpy(np.int64), return_inverse=True)
    u, v = at.reshape(-1, 2).T
    root = np.arange(len(names))
    while True:
        p, q = root[u], root[v]
        apart = p != q
        if not apart.any():
            break
        u, v, p, q = u[apart], v[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while ((up := root[root]) != root).any():
            root = up
    yield pd.DataFrame({"node": names, "component": names[root]})


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node long, component long): each node of an edge with the smallest node that it reaches.

    Up to `small` distinct edges are closed in one task. Beyond that every step is an aggregation with map-side combine and a join on the node, so a hub is split by adaptive
    execution; no component is gathered anywhere. Loops and repeated edges are allowed, an empty table gives none.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = stash(e)
    state = _state(e)
    if 0 < state[0] <= small:
        return stash(e.coalesce(1).mapInPandas(_closed, "node long, component long"))
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
        e = stash(small)
        was, state = state, _state(e)
        if was == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


RANKS = "node long, weight long, head long, before long, total long, cyclic boolean"


def _walked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The places of a few nodes, path by path; cycles from their smallest node."""
    nodes = pd.concat([*parts, pd.DataFrame({"node": np.empty(0, np.int64), "next": np.empty(0, object), "weight": np.empty(0, np.int64)})])
    weight = dict(zip(nodes["node"].astype("int64"), nodes["weight"].astype("int64"), strict=True))
    there = nodes[nodes["next"].notna()]
    after = dict(zip(there["node"].astype("int64"), there["next"].map(int), strict=True))
    led, rows = set(after.values()), []
    for cyclic in (False, True):
        for head in sorted(weight):
            if head in weight and (cyclic or head not in led):
                line, before, at = [], 0, head
                while at is not None and at in weight:
                    line.append((at, weight[at], before))
                    before += weight.pop(at)
                    at = after.get(at)
                rows += [(n, w, head, b, before, cyclic) for n, w, b in line]
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in RANKS.split(", ")])


def ranked(nodes: DataFrame, max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, weight, head, before, total, cyclic) of paths: nodes (node long, next long, weight long), next null at a path's end.

    A node is the next of one other at most. head is the path's first node, before the weight of the nodes ahead of this
    one, total that of all. A cycle is opened at its smallest node. Up to `small` nodes are walked in one task. Beyond that pointers to the head double with every round, so a path of n
    nodes takes about log2(n) joins and is gathered nowhere.
    """
    nodes = stash(nodes.select("node", "next", "weight"))
    if nodes.count() <= small:
        exact = nodes.select("node", F.col("next").cast("string").alias("next"), "weight")  # a null would make 64-bit names inexact
        return stash(exact.coalesce(1).mapInPandas(_walked, RANKS))
    into = stash(nodes.where("next is not null").select(F.col("next").alias("node"), F.col("node").alias("pred"), F.col("weight").alias("acc")))
    if into.isEmpty():
        return nodes.select("node", "weight", F.col("node").alias("head"), F.lit(0).cast("long").alias("before"), F.col("weight").alias("total"), F.lit(False).alias("cyclic"))
    group = nodes.select("node").join(components(into, "node", "pred", small=small), "node", "left").select("node", F.coalesce("component", "node").alias("group"))
    begun = group.join(into, "node", "left_anti").select("group").distinct()
    cycles = stash(group.select("group").distinct().join(begun, "group", "left_anti"))
    into = into.join(cycles, into["node"] == cycles["group"], "left_anti")
    at = stash(nodes.select("node", "weight").join(into, "node", "left").select("node", "weight", F.coalesce("pred", "node").alias("head"), F.coalesce("acc", F.lit(0)).cast("long").alias("before")))
    for _ in range(max_rounds):
        ahead = at.select(F.col("node").alias("head"), F.col("head").alias("up"), F.col("before").alias("more"))
        at = stash(at.join(ahead, "head").select("node", "weight", F.col("up").alias("head"), (F.col("before") + F.col("more")).alias("before"), (F.col("up") != F.col("head")).alias("moved")))
        if at.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("paths did not settle")
    whole = at.groupBy("head").agg(F.sum("weight").alias("total")).join(cycles.select(F.col("group").alias("head"), F.lit(True).alias("cyclic")), "head", "left")
    return at.drop("moved").join(whole, "head").select("node", "weight", "head", "before", "total", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
