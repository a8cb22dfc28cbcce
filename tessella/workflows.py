"""Whole runs: train a head, predict a region's mask from tokens, publish it with a receipt, verify it, evaluate it."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import components, features, grid, metrics, overlay, projection, repair, stencil, topology, vector
from tessella.plans.durable import stash
from tessella.sources import sinks

SMOOTHING, SMALLEST_UM2 = 0.75, 400.0  # of scores, in tokens; of regions. Fixed values.
CONTOUR_UM, SLIDE_UM2 = 6.0, 2000.0  # of a slide's contours; of its regions before they become polygons. Fixed values.


def train(tok: DataFrame, width: int, path: str, alpha: float = 10.0, balanced: bool = True) -> str:
    """Fit a ridge head on (feat, class_id) and save it; returns its digest."""
    head = features.ridge_of(features.class_grams(tok.withColumn("fold", F.lit(0)), width, "fold"), [0], alpha, balanced)
    state = {"classes": [int(c) for c in head.classes], "coef": head.coef.tolist(), "intercept": head.intercept.tolist()}
    return sinks.save_state(tok.sparkSession, json.dumps(state), path)


def load_head(spark: SparkSession, path: str) -> features.Ridge:
    s = json.loads(sinks.load_state(spark, path))
    return features.Ridge(s["classes"], np.array(s["coef"]), np.array(s["intercept"]))


def predict(tok: DataFrame, head: features.Ridge, tokens: tuple[int, int], working: tuple[int, int], display: tuple[int, int], mpp: tuple[float, float], allowed: Sequence[int], side: int = 14) -> DataFrame:
    """(key, label) at display size: linear scores, smoothed on the token grid, projected, decided among allowed classes, small regions repaired.

    tok: (key, feat), finite, one row a token; sizes are (height, width), mpp the display's (x, y).
    """
    scores = features.ridge_scores(tok, head).select(*grid.KEY, F.posexplode("scores").alias("k", "score"))
    smooth = grid.gaussian(scores, "score", SMOOTHING, tokens[0], tokens[1], ("k",))
    classes = F.element_at(F.array(*(F.lit(int(c)) for c in head.classes)), F.col("k") + 1)
    mask = projection.roi_mask(smooth.select(*grid.KEY, classes.alias("class_id"), "score"), tokens, working, display, allowed, side, head.classes)
    return repair.repair(mask, "label", repair.threshold_pixels(SMALLEST_UM2, *mpp), "roi")


def _digests(mask: DataFrame) -> dict[str, str]:
    """A digest of each class's cells, by image."""
    own = mask.withColumn("own", F.concat_ws(":", "image_id", F.col("label").cast("string")))
    return {r[0]: r[1] for r in features.block_digests(own, "own", 512).collect()}  # a row a class and image


def publish(mask: DataFrame, path: str, run_id: str, inputs: dict[str, str]) -> DataFrame:
    """Write a mask and, beside it, its receipt (one row), which names the inputs' digests and those of the mask's classes as written.

    Both are refused if there; the receipt comes last, so a run that was cut off has none.
    """
    sinks.write_mask(mask, path)
    spark = mask.sparkSession
    sinks.receipt(spark, run_id, "mask", inputs, _digests(sinks.read_mask(spark, path))).coalesce(1).write.mode("errorifexists").parquet(f"{path}.receipt")
    return spark.read.parquet(f"{path}.receipt")


def verify(spark: SparkSession, path: str, inputs: dict[str, str], receipt: str | None = None) -> int:
    """The number of classes and images whose cells are as the stored receipt says (`receipt`, if it isn't beside the mask); an error if anything differs."""
    r = spark.read.parquet(receipt or f"{path}.receipt").first()
    if r.status != "COMPLETE" or r.inputs != inputs:
        raise ValueError("the receipt is of another run or input")
    if (found := _digests(sinks.read_mask(spark, path))) != r.outputs:
        raise ValueError("the mask differs from its receipt")
    return len(found)


def evaluate(mask: DataFrame, truth: DataFrame) -> DataFrame:
    """class_overlap() of a mask with a truth of the same cells (key, label); cells that only one of them has are an error."""
    pairs = truth.select(*grid.KEY, F.col("label").alias("truth"), F.lit(True).alias("t")).join(mask.select(*grid.KEY, F.col("label").alias("pred"), F.lit(True).alias("p")), list(grid.KEY), "full")
    both = F.col("t").isNotNull() & F.col("p").isNotNull()
    checked = F.when(both, F.col("truth")).otherwise(F.raise_error(F.lit("mask and truth must have the same cells")))
    return metrics.class_overlap(pairs.select(checked.cast("long").alias("truth"), "pred"), "truth", "pred")


def present_classes(scores: DataFrame, inside: DataFrame, floor: float) -> list[int]:
    """The classes that win at least this share of the tokens inside (key); the commonest if none does. scores: (key, class_id, score)."""
    best = scores.join(inside.select(*grid.KEY), list(grid.KEY), "left_semi").groupBy(*grid.KEY).agg(F.max(F.struct("score", (-F.col("class_id")).alias("n")))["n"].alias("n"))
    counts = {-r.n: r.tokens for r in best.groupBy("n").agg(F.count("*").alias("tokens")).collect()}  # a row a class
    if not counts:
        raise ValueError("no token lies on the tissue")
    kept = sorted(c for c, n in counts.items() if n >= floor * sum(counts.values()))
    return kept or [max(sorted(counts), key=counts.get)]


def segment_slide(tok: DataFrame, head: features.Ridge, tokens: tuple[int, int], tissue: DataFrame, frame: DataFrame, mpp: tuple[float, float], native_mpp: tuple[float, float], path: str, run_id: str, inputs: dict[str, str], floor: float = 0.02, side: int = 14) -> DataFrame:
    """Segment whole slides and write mask, native polygons and a receipt under `path`, refused if there; returns the receipt.

    tok: (key, feat), tissue: rings of the reviewed support (image_id, component, label, points), frame: (image_id, height, width),
    mpp: the frame's (x, y). Classes below the presence floor are left out. The best class of the remapped scores is taken on
    the support alone; regions of under SMALLEST_UM2 are repaired, contours smoothed by CONTOUR_UM, regions of under SLIDE_UM2
    repaired. The regions' boundaries become arcs that neighbours share, and polygons in native coordinates. Before the receipt
    the polygons are turned back into cells, which must be those of the mask, on the support alone, and checked for
    validity; a run that was cut off has no receipt.
    """
    spark = tok.sparkSession
    on = vector.rasterize(tissue).select(*grid.KEY).distinct().withColumn("on", F.lit(True))
    every = frame.select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("y"), "width").select("image_id", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("x"))
    support = stash(every.join(on, list(grid.KEY), "left").select(*grid.KEY, F.coalesce("on", F.lit(False)).alias("on")))
    long = features.ridge_scores(tok, head).select(*grid.KEY, F.posexplode("scores").alias("k", "score"))
    scores = stash(long.select(*grid.KEY, F.element_at(F.array(*(F.lit(int(c)) for c in head.classes)), F.col("k") + 1).alias("class_id"), "score"))
    half = side // 2
    inside = support.where(f"on and y % {side} = {half} and x % {side} = {half}").select("image_id", F.expr(f"y div {side}").alias("y"), F.expr(f"x div {side}").alias("x"))
    classes = present_classes(scores, inside, floor)
    raw = projection.project_mask(scores, tokens, support, classes, side)
    carry = lambda labels: labels.join(support, list(grid.KEY))
    first = repair.repair(carry(raw), "label", repair.threshold_pixels(SMALLEST_UM2, *mpp), "wsi", "on")
    smooth = stencil.smoothed(first, (CONTOUR_UM / mpp[1], CONTOUR_UM / mpp[0]), zero=False)
    mask = stash(repair.repair(carry(smooth), "label", repair.threshold_pixels(SLIDE_UM2, *mpp), "wsi", "on"))
    labelled = stash(components.label_components(mask, "label"))
    names = components.component_table(labelled).select("image_id", "component", "label", "area")
    rings = stash(topology.Coverage(labelled).polygons().join(names, ["image_id", "component"]))
    if not carry(mask).where("label > 0 and not on").isEmpty():
        raise ValueError("labels lie off the support")
    if not vector.round_trip_differences(vector.rasterize(rings).select(*grid.KEY, "label"), mask.where("label > 0")).isEmpty():
        raise ValueError("the polygons are not the mask")
    if not overlay.invalid(rings).isEmpty():
        raise ValueError("polygons are invalid or overlap")
    sinks.write_geojson(rings, f"{path}/polygons", mpp[0] / native_mpp[0], mpp[1] / native_mpp[1])
    counts = names.groupBy("label").agg(F.count("*").alias("regions"), F.sum("area").alias("cells")).orderBy("label").collect()  # a row a class
    told = {**inputs, "classes": json.dumps(classes), **{f"class {r.label}": f"{r.regions} regions, {r.cells} cells" for r in counts}}
    return publish(mask, f"{path}/mask", run_id, told)
