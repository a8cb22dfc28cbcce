"""Joins and resampling on grids keyed by (image_id, y, x): every neighbour is found by an equality of shifted keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.blocks import along, on_blocks

KEY = ("image_id", "y", "x")
BLOCK = 256  # side of a block of a stencil


def interfaces(pixels: DataFrame, label: str) -> DataFrame:
    """(image_id, y, x, side, a, b): pixel edges with different labels; side `right` or `down`, a at (y, x), b beyond it.

    Each pixel names its four edges and an edge gathers its two pixels: one exchange with partial aggregation, no join.
    """
    sides = F.array(
        F.struct(F.col("y").alias("ey"), F.col("x").alias("ex"), F.lit("right").alias("side"), F.lit(True).alias("first")),
        F.struct(F.col("y").alias("ey"), (F.col("x") - 1).alias("ex"), F.lit("right").alias("side"), F.lit(False).alias("first")),
        F.struct(F.col("y").alias("ey"), F.col("x").alias("ex"), F.lit("down").alias("side"), F.lit(True).alias("first")),
        F.struct((F.col("y") - 1).alias("ey"), F.col("x").alias("ex"), F.lit("down").alias("side"), F.lit(False).alias("first")),
    )
    e = pixels.select("image_id", F.col(label).alias("l"), F.explode(sides).alias("e")).select("image_id", "l", "e.*")
    e = e.groupBy("image_id", F.col("ey").alias("y"), F.col("ex").alias("x"), "side").agg(F.max(F.when(F.col("first"), F.col("l"))).alias("a"), F.max(F.when(~F.col("first"), F.col("l"))).alias("b"))
    return e.where("a <> b")


def interface_pixels(pixels: DataFrame, label: str) -> DataFrame:
    """Distinct (image_id, y, x) on either side of an interface."""
    e = interfaces(pixels, label)
    other = e.select("image_id", (F.col("y") + (F.col("side") == "down").cast("int")).alias("y"), (F.col("x") + (F.col("side") == "right").cast("int")).alias("x"))
    return e.select(*KEY).unionByName(other).distinct()


def adjacency(pixels: DataFrame, label: str, mpp_x: float, mpp_y: float) -> DataFrame:
    """(image_id, g1 < g2, len_um): boundary length of two groups; left-right edges are mpp_y long, up-down ones mpp_x."""
    e = interfaces(pixels, label)
    side = F.when(F.col("side") == "right", F.lit(float(mpp_y))).otherwise(F.lit(float(mpp_x)))
    return e.groupBy("image_id", F.least("a", "b").alias("g1"), F.greatest("a", "b").alias("g2")).agg(F.sum(side).alias("len_um"))


def offset_means(cells: DataFrame, value: str, height: int, width: int, offsets: Sequence[int] = (1, 2, 4), extra: Sequence[str] = (), edge: str = "nearest", block: int = BLOCK, absent: str = "own") -> DataFrame:
    """(key, *extra, mean): mean of the values up, down, left and right at each offset, edges clamped or reflected.

    A missing or NaN neighbour counts as the cell itself. With absent `out` neighbours that are missing or null are left out of
    the mean instead, as a join leaves them out, NaN is a value, and a cell without any neighbour gets no row. By blocks
    with a halo of the largest offset: one exchange.
    """
    if absent not in ("own", "out"):
        raise ValueError("absent must be own or out")
    reach = max(offsets)

    def kernel(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        v, there, known = w[value], w["there"], w["there"] & w["known_"].astype(bool)
        if absent == "own":
            known = known & ~np.isnan(v)
        pads = [np.pad(a, reach, mode=PADS[edge]) for a in (v, there, known)]
        (h, n), total, met, held = v.shape, np.zeros(v.shape), np.zeros(v.shape, np.int64), np.zeros(v.shape, np.int64)
        for d in offsets:
            for dy, dx in ((-d, 0), (d, 0), (0, -d), (0, d)):
                seen, is_there, is_known = (a[reach + dy : reach + dy + h, reach + dx : reach + dx + n] for a in pads)
                if absent == "own":
                    total = total + np.where(is_known, seen, np.where(known, v, np.nan))
                    met, held = met + 1, held + 1
                else:
                    total = total + np.where(is_known, seen, 0.0)
                    met, held = met + is_there, held + is_known
        return {"total_": total, "met_": met, "held_": held}

    v = F.col(value).cast("double")
    sums = on_blocks(cells.select(*KEY, *extra, F.coalesce(v, F.lit(0.0)).alias(value), v.isNotNull().alias("known_")), [value, "known_"], kernel, "total_ double, met_ long, held_ long", block, reach, extra, (height, width))
    total = F.col("total_") if absent == "own" else F.coalesce("total_", F.lit(float("nan")))  # pandas hands NaN back as null
    return sums.where("met_ > 0").select(*KEY, *extra, F.when(F.col("held_") > 0, total / F.col("held_")).alias("mean"))


PADS = {"nearest": "edge", "mirror": "reflect", "reflect": "symmetric"}  # what numpy calls the edge rules


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised taps of radius int(truncate * sigma + 0.5)."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def gaussian(cells: DataFrame, value: str, sigma: float | tuple[float, float], height: int, width: int, extra: Sequence[str] = (), edge: str = "nearest", block: int = BLOCK) -> DataFrame:
    """(key, *extra, value) blurred along both axes; sigma may differ by axis (y, x). By blocks with a halo of the taps' reach: one exchange.

    Taps beyond the frame fall back inside by the edge rule; cells that are not there add nothing.
    """
    weights = [gaussian_weights(s) for s in (sigma if isinstance(sigma, tuple) else (sigma, sigma))]
    halo = max(len(w) // 2 for w in weights)

    def kernel(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        a = w[value]
        for axis in (0, 1):
            a = along(a, weights[axis], axis, PADS[edge])
        return {value: a}

    known = cells.select(*KEY, *extra, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    return on_blocks(known, [value], kernel, f"{value} double", block, halo, extra, (height, width))


def smoothed_labels(pixels: DataFrame, label: str, sigma: tuple[float, float], height: int, width: int, classes: Sequence[int], edge: str = "mirror", fixed_zero: bool = False) -> DataFrame:
    """(key, label): the class whose one-hot mask, blurred, is largest at a cell; ties to the lower class.

    fixed_zero: cells of label 0 stay 0 and win nowhere.
    """
    hot = pixels.select(*KEY, F.explode(F.array(*(F.struct(F.lit(int(c)).cast("long").alias("c"), (F.col(label) == c).cast("double").alias("q")) for c in classes))).alias("h")).select(*KEY, "h.*")
    blurred = gaussian(hot, "q", sigma, height, width, ("c",), edge)
    best = blurred.groupBy(*KEY).agg((-F.max(F.struct(F.round("q", 9).alias("q"), (-F.col("c")).alias("n")))["n"]).alias("new"))
    out = F.when(F.lit(fixed_zero) & (F.col(label) == 0), F.lit(0)).otherwise(F.col("new"))
    return pixels.join(best, list(KEY)).select(*KEY, out.cast("long").alias("label"))


def masked_gaussian(cells: DataFrame, value: str, mask: str, sigma: float, height: int, width: int) -> DataFrame:
    """(key, value): blur(x * m) / max(blur(m), 1e-6) inside the mask, the value itself outside."""
    both = cells.select(*KEY, F.explode(F.array(F.struct(F.lit(0).alias("part"), (F.col(value) * F.col(mask).cast("double")).alias("q")), F.struct(F.lit(1).alias("part"), F.col(mask).cast("double").alias("q")))).alias("p")).select(*KEY, "p.*")
    blurred = gaussian(both, "q", sigma, height, width, ("part",)).groupBy(*KEY).agg(F.max(F.when(F.col("part") == 0, F.col("q"))).alias("n_"), F.max(F.when(F.col("part") == 1, F.col("q"))).alias("d_"))
    return cells.join(blurred, list(KEY)).select(*KEY, F.when(F.col(mask), F.col("n_") / F.greatest("d_", F.lit(1e-6))).otherwise(F.col(value)).alias(value))


def nearest_resample(cells: DataFrame, values: Sequence[str], height: int, width: int, out_height: int, out_width: int, targets: DataFrame) -> DataFrame:
    """values at each target (image_id, y, x) from the source cell at floor((i + .5) * ratio)."""
    src = lambda c, n, m: F.least(F.floor((F.col(c) + 0.5) * n / m), F.lit(n - 1)).cast("long")
    t = targets.select(*KEY, src("y", height, out_height).alias("sy"), src("x", width, out_width).alias("sx"))
    s = cells.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), *values)
    return t.join(s, ["image_id", "sy", "sx"]).select(*KEY, *values)


def bilinear(cells: DataFrame, value: str, height: int, width: int, ratio: float | tuple[float, float], targets: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(key, *extra, value): linear interpolation at (i + .5) * ratio - .5, edges repeated; four corners joined by equality. The ratio may differ by axis (y, x)."""
    ratios = ratio if isinstance(ratio, tuple) else (ratio, ratio)

    def ends(c: str, n: int, ratio: float) -> tuple[Column, Column, Column]:
        p = F.least(F.greatest((F.col(c) + 0.5) * F.lit(float(ratio)) - 0.5, F.lit(0.0)), F.lit(float(n - 1)))
        low = F.least(F.floor(p), F.lit(max(n - 2, 0))).cast("long")
        return low, F.least(low + 1, F.lit(n - 1)), p - low

    y0, y1, fy = ends("y", height, ratios[0])
    x0, x1, fx = ends("x", width, ratios[1])
    corners = F.array(*(F.struct(yy.cast("long").alias("sy"), xx.cast("long").alias("sx"), (wy * wx).alias("w")) for yy, wy in ((y0, 1 - fy), (y1, fy)) for xx, wx in ((x0, 1 - fx), (x1, fx))))
    looking = targets.select(*KEY, F.explode(corners).alias("c")).select(*KEY, "c.*")
    s = cells.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), *extra, F.col(value).alias("v"))
    return looking.join(s, ["image_id", "sy", "sx"]).groupBy(*KEY, *extra).agg(F.sum(F.col("w") * F.col("v")).alias(value))


def area_resample(cells: DataFrame, value: str | Sequence[str], source_side: int | tuple[int, int], target_side: int | tuple[int, int]) -> DataFrame:
    """(key, value): cells of source_side averaged over target cells of target_side, weighted by exact overlap area; sides may differ by axis (y, x)."""
    def spans(c: str, source: int, target: int) -> Column:
        lo, hi = F.col(c) * source, (F.col(c) + 1) * source
        cells_ = F.sequence(F.floor(lo / target), F.floor((hi - 1) / target))
        return F.transform(cells_, lambda t: F.struct(t.alias("t"), (F.least(hi, (t + 1) * target) - F.greatest(lo, t * target)).alias("n")))

    (sy, sx), (ty, tx) = (v if isinstance(v, tuple) else (v, v) for v in (source_side, target_side))
    values = [value] if isinstance(value, str) else list(value)
    e = cells.select("image_id", F.explode(spans("y", sy, ty)).alias("a_"), "x", *values).select("image_id", "a_", F.explode(spans("x", sx, tx)).alias("b_"), *values)
    w = F.col("a_.n") * F.col("b_.n")
    return e.groupBy("image_id", F.col("a_.t").alias("y"), F.col("b_.t").alias("x")).agg(*((F.sum(w * F.col(v)) / F.sum(w)).alias(v) for v in values))


STRIP = 64  # columns of one strip of the first pass, rows of one of the second


def _columns(key: tuple, targets: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """In a strip of columns: for each wanted row and each column with a target, that target's row which is nearest (the upper of two)."""
    if not (len(targets) and len(rows)):
        return pd.DataFrame({c: np.empty(0, object) for c in ("image_id", "y", "xs", "ys")})
    want, columns, out = np.unique(rows["y"].to_numpy()), [], []
    for x, own in targets.groupby("x", sort=True)["y"]:
        at = np.unique(own.to_numpy())
        below = np.searchsorted(at, want, "right") - 1
        up, down = at[np.maximum(below, 0)], at[np.minimum(below + 1, len(at) - 1)]
        columns.append(x)
        out.append(np.where((below < 0) | (np.abs(down - want) < np.abs(want - up)), down, up))
    return pd.DataFrame({"image_id": np.full(len(want), key[0], object), "y": want, "xs": [columns] * len(want), "ys": np.stack(out, axis=1).tolist()})


def _rows(mpp_y: float, mpp_x: float):
    def run(key: tuple, cells: pd.DataFrame, columns: pd.DataFrame) -> pd.DataFrame:
        """In a strip of rows: each cell's nearest of the columns' targets; ties by row, then column."""
        out, by_row = [], dict(list(columns.groupby("y")))
        for y, own in cells.groupby("y"):
            if y not in by_row:
                continue
            near = by_row[y]
            xs, ys = np.concatenate(near["xs"].to_numpy()).astype(np.int64), np.concatenate(near["ys"].to_numpy()).astype(np.int64)
            x = own["x"].to_numpy(np.int64)
            lo, hi = min(xs.min(), x.min()), max(xs.max(), x.max())
            row = np.full(hi - lo + 1, -1, np.int64)  # the target's row in each column; -1 for none
            row[xs - lo] = ys
            fall = np.where(row >= 0, ((row - y) * mpp_y) ** 2, np.inf)
            best, by, bx, k, open_ = np.full(len(x), np.inf), np.full(len(x), -1), np.full(len(x), -1), 0, np.arange(len(x))
            while len(open_):  # columns k to the left and right, until none farther off can be nearer
                for side in (-k, k) if k else (0,):
                    c = x[open_] - lo + side
                    inside = (c >= 0) & (c < len(row))
                    i, c = open_[inside], c[inside]
                    d = fall[c] + (k * mpp_x) ** 2
                    nearer = (d < best[i]) | ((d == best[i]) & np.isfinite(d) & ((row[c] < by[i]) | ((row[c] == by[i]) & (c + lo < bx[i]))))
                    best[i[nearer]], by[i[nearer]], bx[i[nearer]] = d[nearer], row[c[nearer]], c[nearer] + lo
                k += 1
                open_ = open_[((k * mpp_x) ** 2 <= best[open_]) & (k < len(row))]
            out.append((np.full(len(x), y), x, by, bx, np.sqrt(best)))
        whole = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0)] * 5
        return pd.DataFrame({"image_id": np.full(len(whole[0]), key[0], object), **dict(zip(("y", "x", "sy", "sx", "d"), whole, strict=True))})

    return run


def nearest_cells(a: DataFrame, b: DataFrame, mpp_y: float = 1.0, mpp_x: float = 1.0) -> DataFrame:
    """(key, sy, sx, d): of each cell of a the nearest cell of b in its image, ties by row, then column.

    Exact, in two separable passes: along columns in strips, then along rows; each is one exchange, and no offsets are
    exploded. Cells of an image without any of b get no row.
    """
    strip = lambda c: F.expr(f"{c} div {STRIP}")
    targets = b.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), strip("x").alias("bx"))
    wanted = a.select("image_id", F.col("y").cast("long").alias("y")).distinct().join(targets.select("image_id", "bx").distinct(), "image_id").select(F.col("image_id").alias("i_"), F.col("bx").alias("b_"), "y")
    columns = targets.groupBy("image_id", "bx").cogroup(wanted.groupBy("i_", "b_")).applyInPandas(_columns, "image_id string, y long, xs array<long>, ys array<long>")
    cells = a.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), strip("y").alias("by"))
    columns = columns.withColumn("by", strip("y"))
    return cells.groupBy("image_id", "by").cogroup(columns.groupBy("image_id", "by")).applyInPandas(_rows(float(mpp_y), float(mpp_x)), "image_id string, y long, x long, sy long, sx long, d double")


def nearest_filled(cells: DataFrame, payload: Sequence[str], missing: str) -> DataFrame:
    """(key, sy, sx, *payload): each missing cell with the nearest present one of its image; ties by row, then column.

    An image with missing cells and no present one is an error.
    """
    present, todo = cells.where(~F.col(missing)), cells.where(F.col(missing))
    if todo.join(present.select("image_id").distinct(), "image_id", "left_anti").take(1):
        raise ValueError("no present cell")
    there = present.select("image_id", F.col("y").cast("long").alias("sy"), F.col("x").cast("long").alias("sx"), *payload)
    return nearest_cells(todo, present).join(there, ["image_id", "sy", "sx"]).select(*KEY, "sy", "sx", *payload)


def distances(a: DataFrame, b: DataFrame, mpp_x: float, mpp_y: float) -> DataFrame:
    """(key, d): of each cell of a the exact distance to the nearest of b in its image; no row where its image has none."""
    return nearest_cells(a, b, mpp_y, mpp_x).select(*KEY, "d")


def hann_blend(windows: DataFrame, value: str, side: int, stride: int, floor: float = 0.05) -> DataFrame:
    """(key, value): cells of overlapping square windows, averaged with separable Hann weights not below the floor.

    windows: (image_id, wy, wx, iy, ix, value), window (wy, wx) beginning at stride * (wy, wx).
    """
    hann = lambda c: F.greatest(F.pow(F.sin(F.lit(math.pi) * (F.col(c) + 0.5) / side), 2), F.lit(floor))
    w = windows.withColumns({"y": F.col("wy") * stride + F.col("iy"), "x": F.col("wx") * stride + F.col("ix"), "w_": hann("iy") * hann("ix")})
    return w.groupBy(*KEY).agg((F.sum(F.col("w_") * F.col(value)) / F.sum("w_")).alias(value))


def boxes_at(boxes: DataFrame, points: DataFrame, cell: int) -> DataFrame:
    """points joined with the boxes (box_id, y0, x0, y1, x1; ends excluded) that hold them.

    Boxes are listed under each index cell they touch and points under theirs, so candidates meet by equality and the
    exact test follows.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell))
    listed = boxes.select("*", F.explode(span("y0", "y1")).alias("cy")).select("*", F.explode(span("x0", "x1")).alias("cx"))
    at = points.withColumns({"cy": F.floor(F.col("y") / cell), "cx": F.floor(F.col("x") / cell)})
    return at.join(listed, ["cy", "cx"]).where("y >= y0 and y < y1 and x >= x0 and x < x1").drop("cy", "cx")
