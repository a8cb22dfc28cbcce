"""Connected components of label rasters: run-based labelling inside blocks, seams joined by equality, a graph closure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import components as closure
from tessella.plans.durable import joined_left, stash, whole

BLOCK = 256


def _runs(pdf: pd.DataFrame, eight: bool) -> pd.DataFrame:
    """Labels of one block: horizontal runs of one label are nodes, runs that touch on the next row are united."""
    pdf = pdf.sort_values(["y", "x"], kind="stable")
    ys, xs, ls = (pdf[c].to_numpy(np.int64) for c in ("y", "x", "label"))
    starts = np.flatnonzero(np.concatenate(([True], (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1) | (ls[1:] != ls[:-1]))))
    sizes = np.diff(np.append(starts, len(ys)))
    y, a, label = ys[starts] - ys.min() + 1, xs[starts] - xs.min() + 2, ls[starts]
    b, wide = a + sizes - 1, int(xs.max() - xs.min()) + 6
    reach = int(eight)
    lo = np.searchsorted(y * wide + b, (y - 1) * wide + a - reach)  # of the row above, the first run that ends late enough
    hi = np.maximum(np.searchsorted(y * wide + a, (y - 1) * wide + b + reach, "right"), lo)
    one = np.repeat(np.arange(len(y)), hi - lo)
    two = np.arange(len(one)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    same = label[one] == label[two]
    one, two, root = one[same], two[same], np.arange(len(y))
    while True:  # hook the later root of each pair to the earlier, then let all point at roots
        p, q = root[one], root[two]
        apart = p != q
        if not apart.any():
            break
        one, two, p, q = one[apart], two[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while ((up := root[root]) != root).any():
            root = up
    names = np.repeat(pdf["pixel"].to_numpy()[starts[root]], sizes)  # the root run's first pixel names the part
    return pdf.assign(part=names)[["image_id", "y", "x", "label", "part"]]


def label_components(pixels: DataFrame, label: str, eight: bool = False, block: int = BLOCK, row: int = 1 << 31) -> DataFrame:
    """(image_id, y, x, label, component): same-label neighbours share a component, named by its first pixel y * row + x.

    Labels of 0 or null are no part of any. Blocks of bounded size are labelled alone; only parts that meet across a seam
    enter the graph, whose closure is distributed. A component may span any number of blocks.
    """
    base = pixels.where(F.col(label).isNotNull() & (F.col(label) != 0)).select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(label).cast("long").alias("label"))
    keyed = base.withColumn("pixel", F.col("y") * row + F.col("x")).withColumn("by", F.expr(f"y div {block}")).withColumn("bx", F.expr(f"x div {block}"))
    parts = keyed.groupBy("image_id", "by", "bx").applyInPandas(lambda p: _runs(p, eight), "image_id string, y long, x long, label long, part long")
    parts = stash(parts, cells=True)
    seam = parts.where((F.col("y") % block).isin(0, block - 1) | (F.col("x") % block).isin(0, block - 1))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]
    far = seam.select("image_id", F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("label").alias("label2"), F.col("part").alias("p2"))
    near = seam.select("image_id", "label", "part", F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y2"), (F.col("x") + dx).alias("x2")) for dy, dx in steps))).alias("n")).select("image_id", "label", "part", "n.*")
    met = near.join(far, ["image_id", "y2", "x2"]).where("label = label2 and part <> p2")
    node = lambda c: F.xxhash64("image_id", c)  # noqa: E731  a part's name is unique in its image only
    pairs = stash(met.select("image_id", "part", "p2").distinct())
    of = closure(pairs.select(node("part").alias("a"), node("p2").alias("b")), "a", "b")
    named = pairs.select("image_id", F.explode(F.array("part", "p2")).alias("part")).distinct().withColumn("node", node("part")).join(of, "node").withColumnRenamed("component", "root")
    low = named.groupBy("image_id", "root").agg(F.min("part").alias("component"))
    renamed = stash(named.join(low, ["image_id", "root"]).where("part <> component").select("image_id", "part", "component"))  # only parts that go on beyond a seam
    return whole(joined_left(parts, renamed, ["image_id", "part"]).select("image_id", "y", "x", "label", F.coalesce("component", "part").alias("component")))


def component_table(labelled: DataFrame) -> DataFrame:
    """(image_id, component, label, area, y0, x0, y1, x1), one row a component."""
    return labelled.groupBy("image_id", "component").agg(F.min("label").alias("label"), F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))
