"""Queries over the whole table whose namesakes, held to their SQL, run over a fixed part of it; tests hold these to brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import components, grid
from tessella.plans.registry import query
from tessella.sources import fixtures as X


def _size(cells: DataFrame) -> tuple[int, int]:
    h, w = cells.agg(F.max("y") + 1, F.max("x") + 1).first()
    return h or 0, w or 0


@query()
def op_R03_nearest_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster at half its height and width."""
    p = X.raster(spark, sf_dir)
    h, w = _size(p)
    half = p.where((F.col("y") < (h + 1) // 2) & (F.col("x") < (w + 1) // 2))
    return grid.nearest_resample(p, ["pred"], h, w, (h + 1) // 2, (w + 1) // 2, half).select("y", "x", F.col("pred").alias("label"))


@query()
def op_R04_bilinear_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster at twice its height and width."""
    p = X.raster(spark, sf_dir)
    h, w = _size(p)
    two = F.sequence(F.lit(0), F.lit(1))
    double = p.select("image_id", (F.col("y") * 2).alias("y2"), (F.col("x") * 2).alias("x2"), F.explode(two).alias("dy")).select("*", F.explode(two).alias("dx"))
    double = double.select("image_id", (F.col("y2") + F.col("dy")).alias("y"), (F.col("x2") + F.col("dx")).alias("x"))
    return grid.bilinear(p, "value", h, w, 0.5, double).select("y", "x", F.round("value", 6).alias("value"))


@query()
def op_R05_area_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.area_resample(X.raster(spark, sf_dir), "value", 3, 8).select("y", "x", F.round("value", 8).alias("value"))


@query()
def op_A16_tile_qc_area_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact overlap area of each QC category (cells 3 wide) with each tile (8 wide)."""
    span = lambda c: F.transform(F.sequence(F.expr(f"({c} * 3) div 8"), F.expr(f"({c} * 3 + 2) div 8")), lambda t: F.struct(t.alias("t"), (F.least(F.col(c) * 3 + 3, t * 8 + 8) - F.greatest(F.col(c) * 3, t * 8)).alias("n")))
    e = X.raster(spark, sf_dir).select("event_type", F.explode(span("y")).alias("a"), "x").select("event_type", "a", F.explode(span("x")).alias("b"))
    return e.groupBy(F.col("a.t").alias("ty"), F.col("b.t").alias("tx"), "event_type").agg(F.sum(F.col("a.n") * F.col("b.n")).alias("area"))


@query()
def op_R08_contour_smoothing_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.raster(spark, sf_dir)
    classes = sorted(r[0] for r in p.select("pred").distinct().collect())
    return grid.smoothed_labels(p, "pred", (1.5, 1.5), *_size(p), classes).select("y", "x", "label")


@query()
def op_R16_distance_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each cell to the nearest interface cell; rows are 2 apart, columns 1."""
    p = X.raster(spark, sf_dir)
    return grid.distances(p, grid.interface_pixels(p, "truth"), 1.0, 2.0).select("y", "x", F.round("d", 6).alias("d"))


@query()
def op_M21_hann_blend_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.sequence(F.lit(0), F.lit(7))
    t = X.tokens(spark, sf_dir).select("image_id", F.col("y").alias("wy"), F.col("x").alias("wx"), F.explode(side).alias("iy")).select("*", F.explode(side).alias("ix"))
    w = t.withColumn("value", F.expr("(wy * 7 + wx * 3 + iy + ix) % 11").cast("double"))
    return grid.hann_blend(w, "value", 8, 4).select("y", "x", F.round("value", 6).alias("value"))


@query()
def op_J05_scale_alignment_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half-scale grid read at the full grid's cells."""
    tok = X.tokens(spark, sf_dir)
    ch = X.channels(tok).where("ch = 0")
    half = ch.groupBy(F.lit("e0").alias("image_id"), F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(F.avg("v").alias("v"), F.count("*").alias("n")).where("n = 4")
    return grid.bilinear(half, "v", *_size(half), 0.5, tok).select("y", "x", F.round("v", 6).alias("v"))


@query()
def op_K08_component_order_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component's place within its label: by area, largest first, then bounds (x0, y0, x1, y1) and a digest of its cells."""
    cells = components.label_components(X.raster(spark, sf_dir), "pred", block=64)
    digest = cells.groupBy("image_id", "component").agg(F.sum(F.xxhash64("y", "x").cast("decimal(38,0)")).cast("string").alias("digest"))
    t = components.component_table(cells).join(digest, ["image_id", "component"])
    order = Window.partitionBy("image_id", "label").orderBy(F.desc("area"), "x0", "y0", "x1", "y1", "digest")
    return t.withColumn("rank", F.row_number().over(order).cast("long")).select("label", "rank", "area", "x0", "y0", "x1", "y1")
