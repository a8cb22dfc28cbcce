"""Mask metrics: overlap by class, confusion, region covering, boundary agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.grid import KEY, interface_pixels, nearest_cells


def confusion(pixels: DataFrame, a: str, b: str) -> DataFrame:
    return pixels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def class_overlap(pixels: DataFrame, truth: str, pred: str) -> DataFrame:
    """(class_id, inter, n_truth, n_pred, iou, dice) over pixels with truth > 0, for each class in the truth.

    A prediction where the truth is 0 is no false positive. One exchange of the small confusion table.
    """
    c = confusion(pixels.where(F.col(truth) > 0), truth, pred)
    sides = c.select(F.explode(F.array(F.struct(F.col("a").alias("class_id"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("b").alias("class_id"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), "a", "b", "n").select("s.*", "a", "b", "n")
    s = sides.groupBy("class_id").agg(
        F.sum(F.when((F.col("t") == 1) & (F.col("a") == F.col("b")), F.col("n")).otherwise(0)).alias("inter"),
        F.sum(F.when(F.col("t") == 1, F.col("n")).otherwise(0)).alias("n_truth"),
        F.sum(F.when(F.col("p") == 1, F.col("n")).otherwise(0)).alias("n_pred"))
    union = F.col("n_truth") + F.col("n_pred") - F.col("inter")
    return s.where("n_truth > 0").withColumns({"iou": F.col("inter") / union, "dice": 2 * F.col("inter") / (F.col("n_truth") + F.col("n_pred"))})


def region_covering(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: covering of ref by pred, of pred by ref, and their mean; inputs (image_id, y, x, component).

    Each region counts by its size times its best intersection over union with a region of the other side.
    """
    both = ref.select(*KEY, F.col("component").alias("r")).join(pred.select(*KEY, F.col("component").alias("p")), list(KEY)).groupBy("image_id", "r", "p").agg(F.count("*").alias("n"))
    size = lambda df, c: df.groupBy("image_id", F.col("component").alias(c)).agg(F.count("*").alias(f"n_{c}"))
    met = both.join(size(ref, "r"), ["image_id", "r"]).join(size(pred, "p"), ["image_id", "p"]).withColumn("iou", F.col("n") / (F.col("n_r") + F.col("n_p") - F.col("n")))

    def side(own: str, df: DataFrame) -> DataFrame:
        best = met.groupBy("image_id", own).agg(F.max("iou").alias("best"))
        return size(df, own).join(best, ["image_id", own], "left").agg((F.sum(F.col(f"n_{own}") * F.coalesce("best", F.lit(0.0))) / F.sum(f"n_{own}")).alias(f"covering_{own}"))

    return side("r", ref).crossJoin(side("p", pred)).select("covering_r", "covering_p", ((F.col("covering_r") + F.col("covering_p")) / 2).alias("covering"))  # one row each


def boundary_distances(a: DataFrame, b: DataFrame, radius: int, mpp_x: float, mpp_y: float) -> DataFrame:
    """(key, d): of each cell of a the distance to the nearest of b, if that is within `radius` cells either way; else null.

    By the two separable passes of the exact nearest cell; no offsets are exploded.
    """
    near = nearest_cells(a, b, mpp_y, mpp_x)
    within = (F.abs(F.col("sy") - F.col("y")) <= radius) & (F.abs(F.col("sx") - F.col("x")) <= radius)
    return a.join(near.select(*KEY, F.when(within, F.col("d")).alias("d")), list(KEY), "left").select(*KEY, "d")


def boundary_f1(pixels: DataFrame, truth: str, pred: str, tolerance: float, mpp_x: float, mpp_y: float) -> DataFrame:
    """One row (n_truth, n_pred, precision, recall, f1): interface pixels within the tolerance of the other side's.

    f1 is null if neither side has an interface and 0 if one has none.
    """
    t, p = interface_pixels(pixels, truth), interface_pixels(pixels, pred)
    r = int(tolerance / min(mpp_x, mpp_y))
    near = lambda d, n: d.agg(F.count("*").alias(f"n_{n}"), F.count_if(F.col("d") <= tolerance).alias(f"hit_{n}"))
    m = near(boundary_distances(t, p, r, mpp_x, mpp_y), "truth").crossJoin(near(boundary_distances(p, t, r, mpp_x, mpp_y), "pred"))  # one row each
    precision, recall = F.when(F.col("n_pred") > 0, F.col("hit_pred") / F.col("n_pred")), F.when(F.col("n_truth") > 0, F.col("hit_truth") / F.col("n_truth"))
    m = m.withColumns({"precision": precision, "recall": recall})
    f1 = F.when((F.col("n_truth") == 0) & (F.col("n_pred") == 0), F.lit(None)).when((F.col("n_truth") == 0) | (F.col("n_pred") == 0) | (F.col("precision") + F.col("recall") == 0), F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return m.select("n_truth", "n_pred", "precision", "recall", f1.alias("f1"))
