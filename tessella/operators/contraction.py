"""Small regions of label rasters merged by priority: a contraction of the region-adjacency graph, in parallel, with one rewrite of the raster."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.components import label_components
from tessella.operators.graph import components
from tessella.operators.grid import KEY
from tessella.operators.repair import RING
from tessella.plans.durable import joined_left, stash

MOST = 20_000  # contacts of a group of touching small parts that one task contracts
EVENTS = "image_id string, c long, size long, into long, mass long, tied array<long>"


def region_contacts(parts: DataFrame, cells: DataFrame) -> DataFrame:
    """(image_id, c, n, contact): cells of region n (0: none) on the 8-ring of region c, each once.

    parts: (key, c) of the regions asked about, cells: (key, c) of all.
    """
    looks = F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in RING)))
    ring = parts.select("image_id", "c", looks.alias("r")).select("image_id", "c", "r.y", "r.x").distinct()
    met = ring.join(cells.select(*KEY, F.col("c").alias("n")), list(KEY)).where("n <> c")
    return met.groupBy("image_id", "c", "n").agg(F.count("*").alias("contact"))


def _contracted(minimum: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A group's small parts, the largest first, each merged into the region of its longest contact; what was tied goes with it.

        forced: a winner among tied regions, by an earlier pass.
        """
        first = pdf.drop_duplicates("c")
        size = dict(zip(first["c"], first["size"], strict=True))
        now = dict(zip(first["c"], first["now"], strict=True))
        forced = {c: int(f) for c, f in zip(first["c"], first["forced"], strict=True) if not pd.isna(f)}
        touch: dict[int, dict[int, int]] = {c: {} for c in size}
        there = pdf[pdf["n"].notna()]
        for c, n, k, s in zip(there["c"], there["n"].astype("int64"), there["contact"].astype("int64"), there["n_size"].astype("int64"), strict=True):
            touch[c][n] = touch[c].get(n, 0) + k
            now.setdefault(n, s)
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while c in parent:
                c = parent[c]
            return c

        rows = []
        for c in sorted(size, key=lambda c: (-size[c], c)):
            if now[c] >= minimum:
                continue
            contacts: dict[int, int] = {}
            for n, k in touch[c].items():
                n = root(n)
                if n not in (c, 0):
                    contacts[n] = contacts.get(n, 0) + k
            tied = [n for n, k in contacts.items() if k == max(contacts.values())]
            won = forced[c] if forced.get(c) in tied else max(tied, key=lambda n: (now[n], -n), default=0)
            rows.append((c, size[c], won, now[c], sorted(tied) if len(tied) > 1 else None))
            parent[c] = won
            now[won] = now.get(won, 0) + now[c]
            if won in touch:
                for n, k in touch[c].items():
                    touch[won][n] = touch[won].get(n, 0) + k
        return pd.DataFrame(rows, columns=["c", "size", "into", "mass", "tied"]).assign(image_id=pdf["image_id"].iloc[0])[["image_id", "c", "size", "into", "mass", "tied"]]

    return run


def _grouped(adj: DataFrame) -> DataFrame:
    """adj with `group`, by which small parts that touch one another hang together, and `rows`, its contacts."""
    node = lambda c: F.xxhash64("image_id", c)
    of = components(adj.where("n_small").select(node("c").alias("a"), node("n").alias("b")), "a", "b")
    grouped = adj.withColumn("node", node("c")).join(of, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("node", "component")
    return stash(grouped.join(grouped.groupBy("group").agg(F.count("*").alias("rows")), "group"), cells=True)


def _local_round(adj: DataFrame, minimum: int) -> tuple[DataFrame, DataFrame]:
    """One step on all parts that come before every small part they touch: (their events, the contacts that are left)."""
    first = F.struct(F.col("size"), -F.col("c"))
    parts = stash(adj.groupBy("image_id", "c").agg(F.max("size").alias("size"), F.max("now").alias("now"), F.max("forced").alias("forced")))
    ranks = parts.where(F.col("now") < minimum).select("image_id", F.col("c").alias("n"), first.alias("rank"))
    above = adj.join(ranks, ["image_id", "n"]).groupBy("image_id", "c").agg(F.max("rank").alias("rank"))
    ready = parts.join(above, ["image_id", "c"], "left").where((F.col("now") >= minimum) | F.col("rank").isNull() | (first > F.col("rank")))
    ready = stash(ready.drop("rank"))
    turn = ready.where(F.col("now") < minimum)
    top = Window.partitionBy("image_id", "c")
    best = adj.select("image_id", "c", "n", "contact", "n_size").join(turn, ["image_id", "c"]).where("n > 0").withColumn("most", F.max("contact").over(top)).where("contact = most")
    best = best.groupBy("image_id", "c").agg(F.array_sort(F.collect_list("n")).alias("tied"), F.max(F.struct("n_size", -F.col("n")))["col2"].alias("by_size"))
    won = turn.join(best, ["image_id", "c"], "left").withColumn("into", F.when(F.array_contains("tied", F.col("forced")), F.col("forced")).otherwise(F.coalesce(-F.col("by_size"), F.lit(0))))
    events = stash(won.select("image_id", "c", "size", "into", F.col("now").alias("mass"), F.when(F.size("tied") > 1, F.col("tied")).alias("tied")))
    gone = events.select("image_id", "c", "into", "mass")
    gain = gone.groupBy("image_id", F.col("into").alias("k")).agg(F.sum("mass").alias("gain"))
    own = parts.select("image_id", F.col("c").alias("k"), "size", F.col("now").alias("own"), "forced")
    left = adj.select("image_id", "c", "n", "contact", "n_size").join(gone.select("image_id", "c", "into"), ["image_id", "c"], "left").withColumn("c", F.coalesce("into", "c")).drop("into")
    left = left.join(gone.select("image_id", F.col("c").alias("n"), F.col("into").alias("to")), ["image_id", "n"], "left").withColumn("n_now", F.when(F.col("to").isNull(), F.col("n_size"))).withColumn("n", F.coalesce("to", "n")).drop("to", "n_size")
    left = left.where("c <> n and c > 0").groupBy("image_id", "c", "n").agg(F.sum("contact").alias("contact"), F.max("n_now").alias("n_now"))
    done = ready.where(F.col("now") >= minimum).select("image_id", "c")
    still = own.join(gone.select("image_id", F.col("c").alias("k")), ["image_id", "k"], "left_anti").join(done.withColumnRenamed("c", "k"), ["image_id", "k"], "left_anti")
    still = still.join(gain, ["image_id", "k"], "left").select("image_id", F.col("k").alias("c"), "size", (F.col("own") + F.coalesce("gain", F.lit(0))).alias("now"), "forced")
    left = still.join(left, ["image_id", "c"], "left").join(gain.withColumnRenamed("k", "n"), ["image_id", "n"], "left")
    known = F.coalesce(F.col("n_now"), F.lit(0)) + F.coalesce("gain", F.lit(0))
    small = still.select("image_id", F.col("c").alias("n"), F.lit(True).alias("n_small"))
    left = left.join(small, ["image_id", "n"], "left").select("image_id", "c", "size", "now", "n", "contact", known.alias("n_size"), F.coalesce("n_small", F.lit(False)).alias("n_small"), "forced")
    return events, stash(left)


def _events(grouped: DataFrame, forced: DataFrame | None, minimum: int, most: int) -> DataFrame:
    """(image_id, c, size, into, mass, tied): what becomes of each small part.

    Groups of touching small parts are independent; those of `most` contacts or fewer are contracted in tasks, many of them in one call. Larger ones go on by
    rounds, in each of which every part that comes before its small neighbours takes its turn, until they have come apart.
    """
    out = None
    grouped = grouped.withColumn("forced", F.lit(None).cast("long")) if forced is None else joined_left(grouped, forced, ["image_id", "c"])
    while True:
        few = grouped.where(F.col("rows") <= most)
        calls = few.count() // most + 1  # of `most` contacts each, more or less
        dealt = few.withColumn("call", F.pmod(F.xxhash64("group"), F.lit(calls))).drop("rows", "group")
        done = stash(dealt.groupBy("image_id", "call").applyInPandas(_contracted(minimum), EVENTS), cells=True)
        out = done if out is None else out.unionByName(done)
        adj = grouped.where(F.col("rows") > most).drop("rows", "group")
        if adj.isEmpty():
            return out
        events, adj = _local_round(stash(adj), minimum)
        out = out.unionByName(events)
        grouped = _grouped(adj)


def _sized(events: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, c, into): of each part with tied regions the one that is larger when its turn comes, then the first.

    What merged into a region before is summed along the order of turns; a region's turns are dealt out in ranges.
    """
    turns = events.select("image_id", F.col("into").alias("n"), "size", "c", "mass", F.lit(False).alias("asks"))
    asks = events.where("tied is not null").select("image_id", F.explode("tied").alias("n"), "size", "c", F.lit(0).cast("long").alias("mass"), F.lit(True).alias("asks"))
    order = [F.desc("size"), F.asc("c"), F.desc("asks")]
    rows = turns.unionByName(asks).join(asks.select("image_id", "n").distinct(), ["image_id", "n"], "left_semi")
    rows = stash(rows.repartitionByRange("image_id", "n", *order).sortWithinPartitions("image_id", "n", *order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    own = Window.partitionBy("image_id", "n", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = rows.groupBy("image_id", "n", "part").agg(F.sum("mass").alias("whole"))
    before = Window.partitionBy("image_id", "n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("image_id", "n", "part", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("earlier"))
    upto = rows.withColumn("so_far", F.sum("mass").over(own)).where("asks").join(parts, ["image_id", "n", "part"])
    upto = upto.join(sizes.select("image_id", F.col("c").alias("n"), F.col("size").alias("n_size")), ["image_id", "n"])
    return upto.groupBy("image_id", "c").agg((-F.max(F.struct((F.col("n_size") + F.col("earlier") + F.col("so_far")).alias("s"), (-F.col("n")).alias("n")))["n"]).alias("right"))


def _final(events: DataFrame) -> DataFrame:
    """(image_id, c, root): where each part ends up, by pointer doubling."""
    at = stash(events.select("image_id", "c", F.col("into").alias("root")), cells=True)
    while True:
        up = at.select("image_id", F.col("c").alias("root"), F.col("root").alias("up"))
        at = stash(at.join(up, ["image_id", "root"], "left").select("image_id", "c", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), cells=True)
        if at.where("moved").isEmpty():
            return at.drop("moved")


def fill_small_regions(pixels: DataFrame, label: str, minimum: int = 20, block: int = 256, most: int = MOST) -> DataFrame:
    """(key, label): 8-connected regions of fewer than `minimum` cells take the label of the region of their longest contact.

    The largest small part comes first (of equals the one whose first cell is first). It joins the region with most cells on its 8-ring;
    ties go to the larger region, then to the one that begins first. Parts that join one another add up their cells and
    contacts, and what thereby reaches the minimum stays. A part that touches no region becomes 0. Then enclosed holes of
    fewer than `minimum` cells of 0 take the commonest label on their ring, of equally common ones that of the first cell.
    All cells of 0 at the frame's outside, and holes that reach the frame, stay.

    The graph of small parts and their contacts is contracted, not the raster: groups of touching small parts independently, the
    cells are written once. Only the size of a region that ties ask for depends on other groups; such choices are
    checked against the sums of all merges before their turn, and contracted again where they differ, which ends at
    what one part after another would give. Null labels count as 0, an empty raster gives none.
    """
    if minimum < 1:
        raise ValueError("minimum must be positive")
    base = stash(pixels.select(*KEY, F.coalesce(F.col(label), F.lit(0)).cast("long").alias("label")), cells=True)
    cells = stash(label_components(base, "label", True, block).select(*KEY, "label", (F.col("component") + 1).alias("c")), cells=True)
    sizes = stash(cells.groupBy("image_id", "c").agg(F.count("*").alias("size"), F.min("label").alias("label")), cells=True)
    small = sizes.where(F.col("size") < minimum).select("image_id", "c", "size")
    every = base.select(*KEY).join(cells.drop("label"), list(KEY), "left").select(*KEY, F.coalesce("c", F.lit(0)).alias("c"))
    touch = region_contacts(cells.join(small, ["image_id", "c"], "left_semi"), every)
    of = sizes.select("image_id", F.col("c").alias("n"), F.col("size").alias("n_size"))
    adj = small.join(touch, ["image_id", "c"], "left").join(of, ["image_id", "n"], "left")
    grouped = _grouped(stash(adj.select("image_id", "c", "size", F.col("size").alias("now"), "n", "contact", F.coalesce("n_size", F.lit(0)).alias("n_size"), F.coalesce(F.col("n_size") < minimum, F.lit(False)).alias("n_small")), cells=True))
    forced = None
    while True:
        events = stash(_events(grouped, forced, minimum, most), cells=True)
        right = stash(_sized(events, sizes), cells=True)
        wrong = events.join(right, ["image_id", "c"]).where("into <> right")
        if wrong.isEmpty():
            break
        forced = right.withColumnRenamed("right", "forced")
    names = _final(events).join(sizes.select("image_id", F.col("c").alias("root"), "label"), ["image_id", "root"], "left").select("image_id", "c", F.coalesce("label", F.lit(0)).alias("new"))
    merged = cells.join(names, ["image_id", "c"], "left").select(*KEY, F.coalesce("new", "label").alias("own"))
    now = stash(base.join(merged, list(KEY), "left").select(*KEY, (F.col("label") == 0).alias("void"), F.coalesce("own", "label").alias("label")), cells=True)
    return fill_small_holes(now, minimum, block)


def fill_small_holes(pixels: DataFrame, minimum: int, block: int = 256) -> DataFrame:
    """(key, label): 8-connected parts of the cells marked `void` that have fewer than `minimum` cells and don't reach the frame take their ring's commonest label over 0."""
    void = label_components(pixels.where("void").select(*KEY, F.lit(1).alias("one")), "one", True, block)
    frame = pixels.groupBy("image_id").agg(F.min("y").alias("fy0"), F.max("y").alias("fy1"), F.min("x").alias("fx0"), F.max("x").alias("fx1"))
    box = void.groupBy("image_id", "component").agg(F.count("*").alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    inside = box.where(F.col("n") < minimum).join(F.broadcast(frame), "image_id").where("y0 > fy0 and y1 < fy1 and x0 > fx0 and x1 < fx1").select("image_id", "component")  # one row an image
    holes = stash(void.join(inside, ["image_id", "component"]).select(*KEY, "component"), cells=True)
    looks = F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in RING)))
    ring = holes.select("image_id", "component", looks.alias("r")).select("image_id", "component", "r.y", "r.x").distinct()
    votes = ring.join(pixels.where("label > 0").select(*KEY, "label"), list(KEY)).groupBy("image_id", "component", "label").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("at"))
    won = votes.groupBy("image_id", "component").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "at")).alias("new"))
    filled = stash(holes.join(won, ["image_id", "component"]).select(*KEY, "new"), cells=True)
    return joined_left(pixels, filled, list(KEY)).select(*KEY, F.coalesce("new", "label").alias("label"))
