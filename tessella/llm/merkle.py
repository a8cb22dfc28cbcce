"""A Merkle manifest of a dataset: distributed reduction of large blocks, a small top tree on the driver, broadcast suffix paths."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stash

FAN, BLOCK = 16, 16**3  # nodes of a run; nodes that one task reduces as a block, a power of FAN
TOP = 1 << 14  # nodes that the driver's tree starts from, at most
PATH = "array<struct<left:array<string>,right:array<string>>>"
Path = list[tuple[list[str], list[str]]]


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """SHA-256 of the values in turn: `-` for a null, else the UTF-8 byte count, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def levels(nodes: list[str], most: int | None = None) -> list[list[str]]:
    """The nodes and the levels above: so many of them, or until one node remains."""
    out = [nodes]
    while len(out) <= most if most is not None else len(out[-1]) > 1:
        out.append([digest(out[-1][k : k + FAN]) for k in range(0, len(out[-1]), FAN)])
    return out


def path(tree: list[list[str]], at: int) -> Path:
    """Of node `at` its siblings on either side, level by level up to the last level of the tree."""
    out = []
    for level in tree[:-1]:
        first = at // FAN * FAN
        out.append((level[first:at], level[at + 1 : first + FAN]))
        at //= FAN
    return out


def fold(node: str, steps: Path) -> str:
    """The root that a node and its siblings give."""
    for left, right in steps:
        node = digest([*left, node, *right])
    return node


def _heights(n: int, block: int) -> int | None:
    """Levels of a block of a tree of n nodes: all that it has, or just so many if there are more blocks."""
    return round(math.log(block, FAN)) if n > block else None


def _placed(df: DataFrame, *order: str) -> DataFrame:
    """df with each row's place i in its tree, by the order, and the tree's size n.

    A sort by range deals out a tree of any size; each (tree, part) counts its rows, and what stands before it shifts them.
    """
    dealt = stash(df.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).select("*", F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().alias("at_")))
    parts = dealt.groupBy("tree", "part_").agg(F.min("at_").alias("first_"), F.count("*").alias("rows_"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "part_", (F.coalesce(F.sum("rows_").over(before), F.lit(0)) - F.col("first_")).alias("shift_"), F.sum("rows_").over(whole).alias("n"))
    return dealt.join(parts, ["tree", "part_"]).withColumn("i", F.col("at_") + F.col("shift_")).drop("part_", "at_", "shift_")


def _packed(placed: DataFrame, block: int, *kept: str) -> DataFrame:
    """(tree, block, n, nodes): a row for each `block` consecutive nodes, in order; n is the tree's size."""
    return stash(placed.groupBy("tree", F.floor(F.col("i") / block).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", *kept))).alias("nodes")))


def _roots(packed: DataFrame, block: int) -> DataFrame:
    """(tree, i, n, h): each block's node of the level above, n of them in the tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            tops = [levels([h.hex() for h in v], _heights(k, block))[-1][0] for k, v in zip(n, nodes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([-(-k // block) for k in n], pa.int64()), pa.array([bytes.fromhex(t) for t in tops], pa.binary())], ["tree", "i", "n", "h"])

    return stash(packed.select("tree", "block", "n", F.col("nodes.h").alias("h")).mapInArrow(run, "tree string, i long, n long, h binary"))


class _Top:
    """The top tree: each tree's nodes to its subroot, the subroots to the root. A run's digests are held once for all its paths."""

    def __init__(self, nodes: list[tuple[str, str]]):
        trees: dict[str, list[str]] = {}
        for tree, h in nodes:
            trees.setdefault(tree, []).append(h)
        self.place = {t: k for k, t in enumerate(trees)}
        self.trees = {t: levels(v) for t, v in trees.items()}
        self.whole = levels([v[-1][0] for v in self.trees.values()])

    def suffix(self, tree: str, i: int) -> tuple[Path, str, str]:
        """The path of node i of a tree to the root, its subroot and the root."""
        own = self.trees[tree]
        return path(own, i) + path(self.whole, self.place[tree]), own[-1][0], self.whole[-1][0]


def _suffixes(df: DataFrame, nodes: DataFrame, on: str, block: int, top: int) -> tuple[DataFrame, Callable]:
    """df, and how a task finds the suffix path of one of its rows: suffix(row) of the columns tree and `on`.

    nodes (tree, i, n, h): where they are no more than `top`, the driver builds the tree above and broadcasts it. More are
    reduced by blocks again (once each tree has come to one node, the trees' subroots are the nodes), and their paths joined.
    """
    if nodes.count() <= top:
        found = nodes.select("tree", "i", "h").collect()
        up = df.sparkSession.sparkContext.broadcast(_Top([(r.tree, r.h.hex()) for r in sorted(found, key=lambda r: (r.tree.encode(), r.i))]))
        return df, lambda row: up.value.suffix(row["tree"], row[on])
    paths = _paths(nodes, block, top).withColumnsRenamed({"tree": "tree_", "i": "i_"})
    joined = df.join(paths, (df["tree"] == paths["tree_"]) & (df[on] == paths["i_"])).drop("tree_", "i_")
    return joined, lambda row: ([(p["left"], p["right"]) for p in row["path"]], row["subroot"], row["root"])


def _paths(nodes: DataFrame, block: int, top: int) -> DataFrame:
    """(tree, i, path, subroot, root) of nodes that are too many for the driver."""
    alone = nodes.where("n > 1").isEmpty()
    if alone:  # each is a subroot
        nodes = _placed(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "h"), "name")
    else:
        nodes = nodes.withColumn("name", F.lit(None).cast("string"))
    packed = _packed(nodes, block, "h", "name")
    source, suffix = _suffixes(packed, _roots(packed, block), "block", block, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                above, subroot, root = suffix(row)
                tree = levels([x["h"].hex() for x in row["nodes"]], _heights(row["n"], block))
                out = [{"tree": x["name"] if alone else row["tree"], "i": 0 if alone else x["i"], "path": [{"left": a, "right": b} for a, b in path(tree, at) + above], "subroot": x["h"].hex() if alone else subroot, "root": root} for at, x in enumerate(row["nodes"])]
                for at in range(0, len(out), 256):
                    yield pa.RecordBatch.from_pylist(out[at : at + 256], schema=kind)

    kind = pa.schema([("tree", pa.string()), ("i", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))), ("subroot", pa.string()), ("root", pa.string())])
    return stash(source.mapInArrow(run, f"tree string, i long, path {PATH}, subroot string, root string"))


def manifest(docs: DataFrame, found: Column | None = None, proofs: bool = False, block: int = BLOCK, top: int = TOP, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text") -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    A row's leaf is the hash of its five columns. Within a source leaves stand by doc_id (null first), every FAN of them
    become a node, and so on up to one, the subroot; the subroots, by source (null first, bytewise), likewise give the root.
    found: the text as it is now, where that isn't the text of the manifest; folded_root is what it gives with the original
    siblings, and verified tells whether that is the root. proof_sha256 hashes the siblings; `proofs` also returns them, level
    by level, left and right of the row's node.

    Leaves are dealt out by a sort over ranges, so a source of any size spreads. Blocks of 4,096 leaves are reduced in
    tasks; the driver holds at most `top` nodes, broadcasts the paths from them up, and tasks join these to their own
    part of the path. Rows alike in doc_id stand by their leaves; those alike in all columns may swap places. Null doc_ids,
    sources, texts and numbers are values of their own, an empty text is not null, an empty table gives no rows.
    """
    names = {"doc_id": F.col(doc_id), "source": F.col(source), "lang": F.col(lang), "n_chars": F.col(n_chars), "text": F.col(text)}
    hashed = lambda **new: F.unhex(leaf(*(names | new).values()))
    rows = docs.select(
        names["doc_id"].alias("doc_id"), names["source"].alias("source"),
        F.coalesce(F.concat(F.lit("1"), names["source"].cast("string")), F.lit("0")).alias("tree"),
        hashed().alias("h"),
        (F.lit(None).cast("binary") if found is None else F.when(~names["text"].eqNullSafe(found), hashed(text=found))).alias("now"),
        F.monotonically_increasing_id().alias("row"),
    )
    packed = _packed(_placed(stash(rows), "doc_id", "h", "row"), block, "h", "doc_id", "source", "now")
    blocks, suffix = _suffixes(packed, _roots(packed, block), "block", block, top)
    simple = [rows.schema[c].dataType.simpleString() for c in ("doc_id", "source")]
    columns = f"doc_id {simple[0]}, source {simple[1]}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (f", proof {PATH}" if proofs else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = batch.schema.field("nodes").type.value_type
            ids = [inside.field(inside.get_field_index(c)).type for c in ("doc_id", "source")]
            for row in batch.to_pylist():
                above, subroot, root = suffix(row)
                nodes = row["nodes"]
                tree = levels([x["h"].hex() for x in nodes], _heights(row["n"], block))
                out: list[list] = [[], [], []]
                kept = []
                for at, node in enumerate(tree[0]):
                    steps = path(tree, at) + above
                    now = fold(nodes[at]["now"].hex() if nodes[at]["now"] is not None else node, steps)
                    for column, value in zip(out, (digest([d for left, right in steps for d in (*left, *right)]), now, now == root), strict=True):
                        column.append(value)
                    if proofs:
                        kept.append([{"left": a, "right": b} for a, b in steps])
                same = lambda v, n=len(nodes): pa.array([v] * n, pa.string())
                columns = [pa.array([x["doc_id"] for x in nodes], ids[0]), pa.array([x["source"] for x in nodes], ids[1]), pa.array(tree[0], pa.string()), same(subroot), same(root), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.bool_())]
                if proofs:
                    columns.append(pa.array(kept, pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))))
                yield pa.RecordBatch.from_arrays(columns, [*("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"), *(["proof"] if proofs else [])])

    return blocks.mapInArrow(run, columns)
