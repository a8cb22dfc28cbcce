"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stash, unit_hash

Tree = dict  # region -> rack -> shard -> weight; names are integers


def layout(shards: int, per_rack: int = 4, racks: int = 2) -> Tree:
    """Shards 0..shards-1 of weight 1 in racks of per_rack and regions of `racks` racks."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(rack // racks, {}).setdefault(rack, {})[s] = 1.0
    return tree


def grown(tree: Tree) -> Tree:
    """The tree with one more shard, in a rack and a region of its own.

    No other subtree's weight changes, so no draw inside one does: rows move only to the new region, thus the new shard.
    """
    shards = [s for r in tree.values() for k in r.values() for s in k]
    rack = max((k for r in tree.values() for k in r), default=-1) + 1
    return {**tree, max(tree, default=-1) + 1: {rack: {max(shards, default=-1) + 1: 1.0}}}


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _draw(key: Column, level: str, children: dict) -> Column:
    """The child of the smallest -ln(u) / weight: each child wins in proportion to its weight; ties to the smaller name."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    scored = [
        F.struct((-F.log(unit_hash(key, F.lit(level), F.lit(int(name)))) / F.lit(_weight(sub))).alias("s"), F.lit(int(name)).alias("n"))
        for name, sub in sorted(children.items())
        if _weight(sub) > 0
    ]
    return F.array_min(F.array(*scored))["n"] if len(scored) > 1 else scored[0]["n"]


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key: a draw among regions, then among that region's racks, then among that rack's shards."""
    def case(at: Column, options: list[tuple[int, Column]]) -> Column:
        out = F.when(at == options[0][0], options[0][1])
        for name, value in options[1:]:
            out = out.when(at == name, value)
        return out

    key = key.cast("string")
    region = _draw(key, "region", tree)
    racks = {r: _draw(key, f"rack of {r}", subs) for r, subs in tree.items()}
    rack = case(region, sorted(racks.items()))
    shards = {k: _draw(key, f"shard of {k}", subs) for r in tree.values() for k, subs in r.items()}
    return case(rack, sorted(shards.items()))


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", rows_per_slice: int = 20_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row.

    law is `key`: doc_id and the shard count decide, and one more shard takes rows only into itself (grown_shard is the
    shard then). size: the text's UTF-8 bytes plus 1; a null text has none, and the crc32 of no bytes, 0. A null doc_id
    is a key of its own. Slots number each shard's rows from 0 without gaps; a shard is cut into slices by a hash, slices
    are numbered apart and shifted by the counts before them, so no shard meets in one task. Rows alike in doc_id and
    text may swap slots.
    """
    tree = layout(shards)
    body = F.col(text).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = rows.withColumn("shard", place(F.col("doc_id"), tree).cast("int")).withColumn("grown_shard", place(F.col("doc_id"), grown(tree)).cast("int"))
    rows = stash(rows.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text_crc32", "size")))
    slices = max(1, math.ceil(rows.count() / (shards * rows_per_slice)))
    rows = rows.withColumn("slice", F.pmod("h", F.lit(slices)))
    counts = rows.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("s_"), F.col("slice").alias("c_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "slice").orderBy("h", "doc_id", "text_crc32", "size")
    out = rows.withColumn("i", F.row_number().over(own))
    out = out.join(starts, (out["shard"] == starts["s_"]) & (out["slice"] == starts["c_"]))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("i") - 1).cast("long").alias("slot"), "grown_shard")
