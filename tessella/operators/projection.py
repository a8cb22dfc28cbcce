"""Class scores projected to pixels by separable kernels, shards assembled to one raster, parts matched one to one."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.grid import KEY
from tessella.plans.durable import stash

BINARY = (2, 4)  # classes of the binary rule: the second where its score is positive. Fixed values.
SMOOTH, SHARP = -0.5, -0.75  # the cubic kernel's free parameter: of image resizing with antialiasing, and of remapping. Fixed values.


def cubic(t: Column, a: float) -> Column:
    """The cubic convolution kernel at distance t >= 0."""
    near, far = ((a + 2) * t - (a + 3)) * t * t + 1, (((t - 5) * t + 8) * t - 4) * a
    return F.when(t < 1, near).when(t < 2, far).otherwise(F.lit(0.0))


def resize_weights(spark: SparkSession, n: int, m: int) -> DataFrame:
    """(o, s, w): what each of m outputs takes of n inputs along an axis: a cubic, widened when shrinking, cut and normalised at the ends."""
    wide = max(n / m, 1.0)
    centre = (F.col("id") + 0.5) * (n / m)
    lo, hi = F.greatest(F.floor(centre - 2 * wide + 0.5), F.lit(0)), F.least(F.floor(centre + 2 * wide + 0.5), F.lit(n))
    w = F.transform(F.sequence(lo, hi - 1), lambda k: F.struct(k.cast("long").alias("s"), cubic(F.abs((k - centre + 0.5) / wide), SMOOTH).alias("w")))
    rows = spark.range(m).select(F.col("id").alias("o"), w.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda t, x: t + x["w"])
    return rows.select("o", total.alias("t"), F.explode("w").alias("x")).select("o", "x.s", (F.col("x.w") / F.col("t")).alias("w"))


def remap_weights(spark: SparkSession, n: int, m: int, side: int) -> DataFrame:
    """(o, s, w): four taps around (o + .5) / side - .5, inputs beyond the ends repeated."""
    p = (F.col("id") + 0.5) / side - 0.5
    taps = F.transform(F.array(*map(F.lit, (-1, 0, 1, 2))), lambda k: F.struct(F.least(F.greatest(F.floor(p) + k, F.lit(0)), F.lit(n - 1)).cast("long").alias("s"), cubic(F.abs(p - F.floor(p) - k), SHARP).alias("w")))
    return spark.range(m).select(F.col("id").alias("o"), F.explode(taps).alias("x")).select("o", "x.s", "x.w").groupBy("o", "s").agg(F.sum("w").alias("w"))


def chained(after: DataFrame, before: DataFrame, upto: int) -> DataFrame:
    """The weights of two resizings in turn; of the first, outputs from `upto` on are cropped away."""
    first = before.where(F.col("o") < upto).select(F.col("o").alias("mid"), "s", F.col("w").alias("w1"))
    return after.select("o", F.col("s").alias("mid"), F.col("w").alias("w2")).join(first, "mid").groupBy("o", "s").agg(F.sum(F.col("w1") * F.col("w2")).alias("w"))


def applied(cells: DataFrame, value: str, axis: str, weights: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(key, *extra, value) with the axis resampled by (o, s, w): a join on the input's place and a sum with map-side combine."""
    other = "x" if axis == "y" else "y"
    met = cells.withColumnRenamed(axis, "s").join(weights, "s")
    out = met.groupBy("image_id", other, *extra, F.col("o").alias(axis)).agg(F.sum(F.col("w") * F.col(value)).alias(value))
    return out.select(*KEY, *extra, value)


def _decided(scores: DataFrame, allowed: Sequence[int]) -> DataFrame:
    """(key, label): the allowed class of the largest score, the first of equals (to nine decimals)."""
    ok = scores.where(F.col("class_id").isin(*allowed))
    return ok.groupBy(*KEY).agg((-F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("class_id")).alias("n")))["n"]).alias("label"))


def roi_mask(scores: DataFrame, tokens: tuple[int, int], working: tuple[int, int], display: tuple[int, int], allowed: Sequence[int], side: int = 14, classes: Sequence[int] | None = None) -> DataFrame:
    """(key, label) at display size from (key, class_id, score) on a token grid; sizes are (height, width).

    Scores are enlarged to side pixels a token, cropped to the working frame and resized to the display, channel by channel,
    before the classes are compared. The two cubic resizings of an axis are one table of weights. A head of the classes
    BINARY alone doesn't compare them: its second class is where that one's score is above 0.
    """
    if not allowed or any(not 0 < w <= t * side for w, t in zip(working, tokens, strict=True)) or min(display) < 1:
        raise ValueError("allowed classes and registered sizes are needed")
    spark, out = scores.sparkSession, scores
    for axis, t, w, d in zip(("x", "y"), reversed(tokens), reversed(working), reversed(display), strict=True):
        out = applied(out, "score", axis, chained(resize_weights(spark, w, d), resize_weights(spark, t, t * side), w), ("class_id",))
    if classes is not None and tuple(sorted(classes)) == BINARY:
        if tuple(sorted(allowed)) != BINARY:
            raise ValueError("the binary head needs both its classes allowed")
        score = F.max(F.when(F.col("class_id") == BINARY[1], F.round("score", 9)))
        return out.groupBy(*KEY).agg(F.when(score > 0, BINARY[1]).otherwise(BINARY[0]).cast("long").alias("label"))
    return _decided(out, allowed)


def project_mask(scores: DataFrame, tokens: tuple[int, int], support: DataFrame, allowed: Sequence[int], side: int = 14) -> DataFrame:
    """(key, label) of every cell of support (key, on): the best class of the remapped scores, 0 off the support.

    Only columns and rows of the frame are computed; cells off the support are never compared.
    """
    spark = scores.sparkSession
    height, width = support.agg(F.max("y") + 1, F.max("x") + 1).first()
    out = applied(scores.where(F.col("class_id").isin(*allowed)), "score", "x", remap_weights(spark, tokens[1], width, side), ("class_id",))
    out = applied(out, "score", "y", remap_weights(spark, tokens[0], height, side), ("class_id",))
    on = support.where("on").select(*KEY)
    best = _decided(out.join(on, list(KEY), "left_semi"), allowed)
    return support.select(*KEY).join(best, list(KEY), "left").select(*KEY, F.coalesce("label", F.lit(0)).cast("long").alias("label"))


def assembled(shards: DataFrame, frame: DataFrame) -> DataFrame:
    """(key, label, seen) from shard cells (key, core_y, core_x, core_h, core_w, label): each cell as the one shard whose core holds it.

    frame: (image_id, height, width). An error if shards disagree on a cell (halos included), if a cell is in no core or in
    more than one, or if a halo cell lies off the frame. One exchange by cell; seen: how many shards show the cell.
    """
    inside = (F.col("y") >= F.col("core_y")) & (F.col("y") < F.col("core_y") + F.col("core_h")) & (F.col("x") >= F.col("core_x")) & (F.col("x") < F.col("core_x") + F.col("core_w"))
    per = shards.groupBy(*KEY).agg(F.min("label").alias("label"), F.max("label").alias("high"), F.count("*").alias("seen"), F.count_if(inside).alias("cores"))
    checked = F.when(F.col("label") != F.col("high"), F.raise_error(F.lit("shards disagree"))).when(F.col("cores") != 1, F.raise_error(F.lit("cores leave a gap or overlap"))).otherwise(F.col("label"))
    out = per.select(*KEY, checked.alias("label"), "seen")
    size = per.groupBy("image_id").agg(F.count("*").alias("n"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))
    wrong = frame.join(size, "image_id", "full").where(~(F.col("n").eqNullSafe(F.col("height") * F.col("width")) & (F.col("y0") >= 0) & (F.col("x0") >= 0) & (F.col("y1") < F.col("height")) & (F.col("x1") < F.col("width"))))
    if wrong.take(1):
        raise ValueError("cores leave cells of the frame uncovered, or lie off it")
    return out


def one_to_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, part, other, cells): of each part of a the part of b that shares most cells with it, ties to the greater id.

    a, b: (key, part). An error if a part has no counterpart, two parts have the same, or the numbers of parts differ.
    """
    met = a.join(b.select(*KEY, F.col("part").alias("other")), list(KEY)).groupBy("image_id", "part", "other").agg(F.count("*").alias("cells"))
    met = stash(met)
    best = met.groupBy("image_id", "part").agg(F.max(F.struct("cells", "other")).alias("m")).select("image_id", "part", "m.other", "m.cells")
    n = [df.select("image_id", c).distinct().count() for df, c in ((a, "part"), (b, "part"), (best, "part"), (best, "other"))]
    if len(set(n)) != 1:
        raise ValueError("parts do not map one to one")
    return best


def evidence_weight(y: Column, x: Column, height: int, width: int, rows: int, columns: int, tile: float) -> Column:
    """The weight of a cell of a rows x columns grid over a frame of tiles: .15 at tile edges, 1 at their middles."""
    wave = lambda c, n, m: F.pow(F.sin(math.pi * F.pmod((c + 0.5) * n / m, F.lit(float(tile))) / tile), 2)
    return 0.15 + 0.85 * wave(y, height, rows) * wave(x, width, columns)
