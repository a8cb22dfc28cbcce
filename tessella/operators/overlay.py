"""Exact overlaps of polygon sets and the validity of coverages, by sweeping bands; no rasterizing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.topology import Coverage, crossing, fitted
from tessella.plans.durable import stash

BAND = 16.0


def _sides(rings: DataFrame, owner: str) -> DataFrame:
    """(image_id, owner, ya, xa, yb, xb): the sides of closed rings, downwards, without level ones."""
    p = F.col("points")
    pairs = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.struct(F.least(F.struct(a["y"].alias("y"), a["x"].alias("x")), F.struct(b["y"].alias("y"), b["x"].alias("x"))).alias("a"), F.greatest(F.struct(a["y"].alias("y"), a["x"].alias("x")), F.struct(b["y"].alias("y"), b["x"].alias("x"))).alias("b")))
    s = rings.select("image_id", F.col(owner).alias("owner"), F.explode(pairs).alias("s"))
    return s.select("image_id", "owner", F.col("s.a.y").alias("ya"), F.col("s.a.x").alias("xa"), F.col("s.b.y").alias("yb"), F.col("s.b.x").alias("xb")).where("ya < yb")


def _swept(band: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Areas by pair of owners in a band: between the heights at which sides end or cross, sides keep their order from left to right."""
        low, high = key[1] * band, (key[1] + 1) * band
        ya, xa, yb, xb = (pdf[c].to_numpy(float) for c in ("ya", "xa", "yb", "xb"))
        owner = pdf["owner"].to_numpy()
        slope = (xb - xa) / (yb - ya)
        top, bottom = np.maximum(ya, low), np.minimum(yb, high)
        x0, x1 = xa + slope * (top - ya), xa + slope * (bottom - ya)
        order = np.argsort(np.minimum(x0, x1), kind="stable")
        owner, slope, top, bottom, x0, x1, ya, xa = (c[order] for c in (owner, slope, top, bottom, x0, x1, ya, xa))
        left, right = np.minimum(x0, x1), np.maximum(x0, x1)
        upto = np.searchsorted(left, right, "right")
        heights = [top, bottom]
        for i in range(len(owner)):
            j = np.arange(i + 1, upto[i])
            j = j[(slope[j] != slope[i]) & (top[j] < bottom[i]) & (bottom[j] > top[i])]
            if len(j):
                y = (xa[j] - slope[j] * ya[j] - xa[i] + slope[i] * ya[i]) / (slope[i] - slope[j])
                heights.append(y[(y > np.maximum(top[i], top[j])) & (y < np.minimum(bottom[i], bottom[j]))])
        at = np.unique(np.concatenate(heights))
        total: dict[tuple, float] = {}
        for y, z in zip(at[:-1], at[1:], strict=True):
            mid = (y + z) / 2
            on = np.flatnonzero((top <= y) & (bottom >= z) if z - y > 0 else np.zeros(len(top), bool))
            x = xa[on] + slope[on] * (mid - ya[on])
            by = np.argsort(x, kind="stable")
            x, who, inside = x[by], owner[on[by]], set()
            for k in range(len(who) - 1):
                inside ^= {who[k]}
                if len(inside) > 1 and x[k + 1] > x[k]:
                    held = sorted(inside)
                    area = (z - y) * (x[k + 1] - x[k])
                    for m, a in enumerate(held):
                        for b in held[m + 1 :]:
                            total[a, b] = total.get((a, b), 0.0) + area
        return pd.DataFrame([(key[0], a, b, v) for (a, b), v in total.items()], columns=["image_id", "a", "b", "area"])

    return run


def overlaps(rings: DataFrame, owner: str = "component", band: float = BAND) -> DataFrame:
    """(image_id, a, b, area), a < b: the exact area that two owners' polygons share, where there is any.

    rings: (image_id, owner long, points) closed, inside by the even-odd rule over all rings of an owner. Sides are cut into bands,
    a band is swept in a task: what meets there are the sides of one band, whatever the size of a polygon. In floating point
    to some 1e-12 of a band's extent. No rings, or owners that don't meet, give no rows.
    """
    sides = _sides(rings, owner)
    rows = F.sequence(F.floor(F.col("ya") / band), F.greatest(F.ceil(F.col("yb") / band) - 1, F.floor(F.col("ya") / band)))
    cut = sides.withColumn("band", F.explode(rows))
    return cut.groupBy("image_id", "band").applyInPandas(_swept(band), "image_id string, a long, b long, area double").groupBy("image_id", "a", "b").agg(F.sum("area").alias("area"))


def invalid(rings: DataFrame, owner: str = "component", largest: float = 1e-7, band: float = BAND) -> DataFrame:
    """(image_id, owner, other, problem): rings that are not closed, have no area or cross themselves, and pairs of owners that share more than `largest`.

    rings: (image_id, owner, ring, points).
    """
    p, own = F.col("points"), F.col(owner).alias("owner")
    none = F.lit(None).cast("long").alias("other")
    open_ = rings.where((F.size(p) < 4) | (p[0] != F.element_at(p, -1))).select("image_id", own, none, F.lit("not closed").alias("problem"))
    closed = rings.where((F.size(p) >= 4) & (p[0] == F.element_at(p, -1)))
    twice = F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    flat = closed.where(twice == 0).select("image_id", own, none, F.lit("no area").alias("problem"))
    name = F.xxhash64(F.col(owner), "ring").alias("arc")
    lines = closed.select("image_id", name, F.posexplode(p).alias("pos", "q")).select("image_id", "arc", F.col("pos").cast("long").alias("pos"), F.col("q.y").alias("y"), F.col("q.x").alias("x"))
    alone = lines.withColumn("image_id", F.concat_ws("/", "image_id", F.col("arc").cast("string")))  # each ring against itself
    bad = crossing(alone).select(F.col("arc").alias("arc_")).distinct()
    cross = closed.select("image_id", own, name).join(bad, F.col("arc") == F.col("arc_"), "left_semi").select("image_id", "owner", none, F.lit("crosses itself").alias("problem"))
    over = overlaps(closed, owner, band).where(F.col("area") > largest).select("image_id", F.col("a").alias("owner"), F.col("b").alias("other"), F.lit("overlap").alias("problem"))
    return open_.unionByName(flat).unionByName(cross).unionByName(over).distinct()


LADDER = (1.0, 2 / 3, 1 / 3, 1 / 6, 1 / 12)  # shares of the asked tolerance, in turn. Fixed values.
APART = 1 << 32  # between the labels of two sets of polygons


def agreement(exact: DataFrame, fitted: DataFrame) -> dict:
    """How two coverages (image_id, label, points) agree: IoU by label, the share of area that changed, overlap between labels of the second.

    From exact overlaps, a row a pair of labels. The change is half of what all labels gain and lose, so that a border's move counts once,
    and all of what the outside gains and loses.
    """
    both = exact.select("image_id", "label", "points").unionByName(fitted.select("image_id", (F.col("label") + APART).alias("label"), "points"))
    p = F.col("points")
    twice = F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    area = {r.label: r.a for r in both.groupBy("label").agg((F.sum(twice) / 2).alias("a")).collect()}  # a row a label
    met = {(r.a, r.b): r.area for r in overlaps(both, "label").groupBy("a", "b").agg(F.sum("area").alias("area")).collect()}  # a row a pair of labels
    old, new = {k: v for k, v in area.items() if k < APART}, {k - APART: v for k, v in area.items() if k >= APART}
    shared = {k: met.get((k, k + APART), 0.0) for k in old}
    iou = {k: shared[k] / (old[k] + new.get(k, 0.0) - shared[k]) for k in old}
    moved = sum(old[k] + new.get(k, 0.0) - 2 * shared[k] for k in old) + sum(v for k, v in new.items() if k not in old)
    outside = sum(old.values()) + sum(new.values()) - 2 * sum(v for (a, b), v in met.items() if a < APART <= b)
    return {"iou": iou, "changed": (moved + outside) / 2 / sum(old.values()) if old else 0.0, "same_labels": old.keys() == new.keys(), "overlap": sum(v for (a, b), v in met.items() if a >= APART)}


def compacted(coverage: Coverage, labels: DataFrame, tolerance: float, mpp_y: float = 1.0, mpp_x: float = 1.0, minimum_iou: float = 0.97, maximum_change: float = 0.015, areas: bool = False) -> tuple[DataFrame, list[dict]]:
    """(points, attempts): the coverage's arcs simplified by the largest share of the tolerance that the guards admit, or as they were.

    labels: (image_id, component, label). An attempt is admitted if no label is lost, no two overlap, every label's IoU with
    the exact polygons and the share of area that changed keep their bounds, and fewer pieces are left.
    """
    named = lambda points: coverage.polygons(points).join(labels, ["image_id", "component"])
    exact, before, attempts = stash(named(None)), coverage.points.count(), []
    for share in LADDER:
        points = fitted(coverage, tolerance * share, mpp_y, mpp_x, areas=areas)
        found = agreement(exact, named(points))
        found |= {"tolerance": tolerance * share, "points": points.count()}
        found["admitted"] = found["same_labels"] and found["overlap"] < 1e-7 and min(found["iou"].values(), default=1.0) >= minimum_iou and found["changed"] <= maximum_change and found["points"] < before
        attempts.append(found)
        if found["admitted"]:
            return points, attempts
    return coverage.points, attempts
