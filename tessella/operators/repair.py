"""Small-region repair of label rasters, by physical area."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.components import label_components
from tessella.operators.grid import KEY, gaussian
from tessella.plans.durable import joined_left, stash

RING = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)


def threshold_pixels(area_um2: float, mpp_x: float, mpp_y: float, guard: float = 0.0) -> int:
    """Pixels below which a region is small: its area rounded up, less a guard against representation error."""
    return math.ceil(area_um2 / (mpp_x * mpp_y) - guard)


def small_parts(pixels: DataFrame, value: int, below: int, eight: bool, support: str | None, block: int) -> DataFrame:
    """(key, component) of the value's components of fewer than `below` pixels.

    With a support column (for holes, value 0): only components inside the raster's frame and wholly on the support.
    """
    own = pixels.where(F.col("label") == value)
    parts = label_components(own.withColumn("one", F.lit(1)), "one", eight, block)
    size = parts.groupBy("image_id", "component").agg(F.count("*").alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    size = size.where(F.col("area") < below)
    if support:
        frame = pixels.groupBy("image_id").agg(F.min("y").alias("fy0"), F.max("y").alias("fy1"), F.min("x").alias("fx0"), F.max("x").alias("fx1"))
        size = size.join(F.broadcast(frame), "image_id").where("y0 > fy0 and y1 < fy1 and x0 > fx0 and x1 < fx1")  # one row an image
        on = parts.join(pixels.select(*KEY, F.col(support).alias("on")), list(KEY)).groupBy("image_id", "component").agg(F.bool_and("on").alias("on"))
        size = size.join(on.where("on").select("image_id", "component"), ["image_id", "component"])
    return parts.join(size.select("image_id", "component"), ["image_id", "component"]).select(*KEY, "component")


def winners(pixels: DataFrame, parts: DataFrame, value: int, prefer_positive: bool) -> DataFrame:
    """(image_id, component, winner): the commonest other label on the 8-ring of a part, each ring pixel once; ties to the smallest."""
    looks = F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in RING)))
    ring = parts.select("image_id", "component", looks.alias("r")).select("image_id", "component", "r.y", "r.x").distinct()
    votes = ring.join(pixels.select(*KEY, "label"), list(KEY)).where(F.col("label") != value).groupBy("image_id", "component", "label").agg(F.count("*").alias("n"))
    rank = F.struct((F.lit(prefer_positive) & (F.col("label") == 0)).alias("last"), (-F.col("n")).alias("n"), F.col("label").alias("l"))
    return votes.groupBy("image_id", "component").agg(F.min_by("label", rank).alias("winner"))


def repair(pixels: DataFrame, label: str, minimum_pixels: int, mode: str, support: str | None = None, eight: bool = True, passes: int = 8, block: int = 256) -> DataFrame:
    """(key, label): regions of fewer than minimum_pixels take a neighbour's label, class after class, pass after pass.

    mode `roi`: every region joins its ring's majority, and one without neighbours is an error. `wsi`: positive neighbours
    are preferred to 0, a region without any becomes 0, and small holes on the support, off the frame, are filled.
    `single`: one pass in which 0 competes, holes included where a support is given. Components, votes and the new labels
    are joins by equality; at 8-connectivity regions of one class don't touch, so a class's step is order-free. Passes end
    when nothing changes; `roi` and `wsi` fail if they don't.
    """
    if mode not in ("roi", "wsi", "single") or minimum_pixels < 1:
        raise ValueError("mode must be roi, wsi or single, and minimum_pixels positive")
    extra = [support] if support else []
    now = stash(pixels.select(*KEY, F.col(label).cast("long").alias("label"), *extra), cells=True)
    classes: Sequence[int] = sorted(r[0] for r in now.select("label").distinct().collect() if r[0] > 0)  # a few class ids
    order = [*classes, *([0] if support and mode != "roi" else [])]
    for _ in range(1 if mode == "single" else passes):
        changed = 0
        for value in order:
            parts = stash(small_parts(now, value, minimum_pixels, eight, support if value == 0 else None, block), cells=True)
            if not parts.take(1):
                continue
            won = winners(now, parts, value, mode == "wsi")
            new = parts.join(won, ["image_id", "component"], "left")
            if mode == "roi" and new.where("winner is null").take(1):
                raise ValueError("a small region has no neighbour of another class")
            new = stash(new.select(*KEY, F.coalesce("winner", F.lit(value if value == 0 else 0)).cast("long").alias("new")), cells=True)
            changed += new.where(F.col("new") != value).count()
            now = stash(joined_left(now, new, list(KEY)).select(*KEY, F.coalesce("new", "label").alias("label"), *extra), cells=True)
        if not changed:
            break
    else:
        if mode != "single":
            raise ValueError("repair did not settle")
    return now.select(*KEY, "label")


def tissue_support(rgb: DataFrame, height: int, width: int, mpp_x: float, mpp_y: float, island_um2: float = 100.0, hole_um2: float = 900.0, block: int = 256) -> DataFrame:
    """(key, on boolean): stained cells (image_id, y, x, r, g, b), less small islands, with small enclosed holes filled.

    A cell is stained if its colours, blurred by one pixel, spread by more than 25 or fall below 180. Islands of less than
    island_um2 go, then holes of less than hole_um2 that don't reach the frame fill; both 4-connected over the whole image.
    """
    long = rgb.select(*KEY, F.posexplode(F.array(*(F.col(c).cast("double") for c in "rgb"))).alias("c", "v"))
    blurred = gaussian(long, "v", 1.0, height, width, ("c",), "reflect").groupBy(*KEY).agg(F.max("v").alias("hi"), F.min("v").alias("lo"))
    raw = stash(blurred.select(*KEY, F.when((F.col("hi") - F.col("lo") > 25) | (F.col("lo") < 180), 1).otherwise(0).cast("long").alias("label"), F.lit(True).alias("any")), cells=True)
    pixel = mpp_x * mpp_y
    for value, area, guard in ((1, island_um2, None), (0, hole_um2, "any")):
        gone = stash(small_parts(raw, value, math.ceil(area / pixel), False, guard, block).select(*KEY, F.lit(1 - value).cast("long").alias("new")), cells=True)
        raw = stash(joined_left(raw, gone, list(KEY)).select(*KEY, F.coalesce("new", "label").alias("label"), "any"), cells=True)
    return raw.select(*KEY, (F.col("label") == 1).alias("on"))


def relabel_single_contact(pixels: DataFrame, label: str, below: int, keep_at_frame: bool = False, block: int = 256) -> DataFrame:
    """(key, label): 4-connected parts of fewer than `below` cells take the one non-zero class that all their other neighbours have.

    For rasters of two classes and 0. All is decided on the input, so order plays no part. Parts with a mixed or zero
    contact stay; so do parts at the frame if asked, and the parts of a class that would vanish.
    """
    base = stash(pixels.select(*KEY, F.col(label).cast("long").alias("label")), cells=True)
    counts = {r[0]: r[1] for r in base.groupBy("label").count().collect()}
    if len([c for c in counts if c > 0]) != 2:
        raise ValueError("exactly two classes are expected")
    frame = base.groupBy("image_id").agg(F.min("y").alias("fy0"), F.max("y").alias("fy1"), F.min("x").alias("fx0"), F.max("x").alias("fx1"))
    steps = F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))))
    parts = label_components(base.withColumn("label", F.col("label") + 1), "label", False, block).withColumn("label", F.col("label") - 1)
    size = parts.groupBy("image_id", "component").agg(F.count("*").alias("area"), F.min("label").alias("own"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).where(F.col("area") < below)
    if keep_at_frame:
        size = size.join(F.broadcast(frame), "image_id").where("y0 > fy0 and y1 < fy1 and x0 > fx0 and x1 < fx1")  # one row an image
    cells = parts.join(size.select("image_id", "component", "own"), ["image_id", "component"])
    near = cells.select("image_id", "component", "own", steps.alias("n")).select("image_id", "component", "own", "n.*").join(base, list(KEY)).where("label <> own")
    one = near.groupBy("image_id", "component", "own").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo = hi and lo > 0")
    moved = stash(cells.drop("own").join(one, ["image_id", "component"]).select(*KEY, "own", F.col("lo").alias("new")), cells=True)
    lost = {r[0] for r in moved.groupBy("own").count().collect() if r[0] > 0 and r[1] >= counts[r[0]]}
    moved = moved.where(~F.col("own").isin(*lost)) if lost else moved
    return joined_left(base, moved.select(*KEY, "new"), list(KEY)).select(*KEY, F.coalesce("new", "label").alias("label"))
