"""Diffusion, smoothing and refinement of labels by kernels on blocks with a halo."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import grid
from tessella.operators.blocks import along, on_blocks
from tessella.plans.durable import stash

CONTRAST, FLOOR, STRENGTH, ROUNDS = 0.18, 0.02, 3.0, 16  # of optical densities; of conductances; of neighbours against the cell; steps. Fixed values.
HALO = 24  # steps, the guide's blur and its neighbours' need 20
BLUR, SPREAD = 1.0, 4.0  # of the guide; of probabilities, in cells. Fixed values.

def blurred(a: np.ndarray, sigma_y: float, sigma_x: float, radius: Callable[[float], int], edge: str) -> np.ndarray:
    for axis, sigma in ((0, sigma_y), (1, sigma_x)):
        r = radius(sigma)
        w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        a = along(a, (w / w.sum()).tolist(), axis, edge)
    return a


def diffused(p: np.ndarray, he: np.ndarray, inside: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities (h, w, k) after so many steps to the mean of themselves and their neighbours, weighted by how like the stain is.

    he: colours of 0 to 255, smoothed here and rounded; densities that differ by CONTRAST or more hardly conduct. Cells outside are 0.
    """
    p = np.where(inside[..., None], p, 0.0).astype(np.float64)
    p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-6)
    guide = np.rint(blurred(he.astype(np.float64), BLUR, BLUR, lambda s: int(round(3 * s)), "reflect"))
    density = -np.log((guide + 1) / 256)
    sides = []  # (cells, their neighbours, conductance), both ways along each axis
    for axis in (0, 1):
        a, b = [slice(None)] * 2, [slice(None)] * 2
        a[axis], b[axis] = slice(1, None), slice(None, -1)
        a, b = tuple(a), tuple(b)
        like = np.exp(-((density[a] - density[b]) ** 2).sum(axis=2) / (2 * CONTRAST**2))
        w = STRENGTH * (FLOOR + (1 - FLOOR) * like) * (inside[a] & inside[b])
        sides += [(a, b, w), (b, a, w)]
    own = np.ones(inside.shape)
    for to, _, w in sides:
        own[to] += w
    q = p
    for _ in range(rounds):
        u = p.copy()
        for to, of, w in sides:
            u[to] += w[..., None] * q[of]
        q = u / own[..., None]
    return q


def diffuse(cells: DataFrame, block: int = 256, spread: float = 0.0, rounds: int = ROUNDS) -> DataFrame:
    """(key, label): the class, from 1, of the largest diffused probability of cells (image_id, y, x, p array, r, g, b, inside); 0 outside.

    spread: blur of the probabilities before, in cells. Ties go to the first class. The halo holds all that a cell's result
    depends on, so blocks of any size give the same rows.
    """
    reach = int(round(4 * spread))

    def kernel(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        p, inside = w["p"], w["inside"].astype(bool) & w["there"]
        if not inside.any():
            return {"label": np.zeros(inside.shape, np.int64)}
        if spread and p.shape[2] > 1:
            p = blurred(p, spread, spread, lambda s: int(round(4 * s)), "reflect")
        q = diffused(p, np.stack([w[c] for c in "rgb"], axis=2), inside, rounds)
        return {"label": np.where(inside, q.argmax(axis=2) + 1, 0)}

    return on_blocks(cells, ["p", "r", "g", "b", "inside"], kernel, "label long", block, max(HALO, rounds + 8) + reach)


def guided_labels(probabilities: DataFrame, tokens: tuple[int, int], cells: DataFrame, shape: tuple[int, int], mpp: tuple[float, float], side: int = 14, block: int = 256, sigma_um: float = 1.5) -> DataFrame:
    """(key, label) of native cells (image_id, y, x, r, g, b, support): token probabilities (image_id, y, x, p) diffused along the stain at half the size, then smoothed.

    Probabilities are interpolated at the half-size cells' centres and blurred over SPREAD of them, colours averaged two by two,
    the support taken at every other cell. The labels go back to native cells, 0 outside the support, and the one-hot masks
    of the classes, blurred by sigma_um, compete. mpp: (x, y). A case of glass alone has label 0 throughout.
    """
    h, w = shape
    half = cells.select("image_id", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x"), "r", "g", "b", (F.col("support") & (F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)).alias("s"))
    half = half.groupBy(*grid.KEY).agg(*(F.round(F.avg(c)).alias(c) for c in "rgb"), F.bool_or("s").alias("inside"))
    long = probabilities.select(*grid.KEY, F.posexplode("p").alias("k", "v"))
    at = grid.bilinear(long, "v", tokens[0], tokens[1], 2 / side, half.select(*grid.KEY), ("k",))
    p = at.groupBy(*grid.KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("p"))  # a value a class
    small = diffuse(half.join(p, list(grid.KEY)), block, SPREAD).select("image_id", F.col("y").alias("y_"), F.col("x").alias("x_"), "label")
    native = cells.select(*grid.KEY, "support", F.expr("y div 2").alias("y_"), F.expr("x div 2").alias("x_")).join(small, ["image_id", "y_", "x_"])
    native = native.select(*grid.KEY, F.when(F.col("support"), F.col("label")).otherwise(0).cast("long").alias("label"))
    return smoothed(native, (sigma_um / mpp[1], sigma_um / mpp[0]), block)


def smoothed(pixels: DataFrame, sigma: tuple[float, float], block: int = 256, zero: bool = True) -> DataFrame:
    """(key, label): the class whose one-hot mask, blurred by sigma (y, x), is largest; ties to the lower class. Cells of 0 stay 0; 0 competes if `zero`."""
    reach = max(int(round(4 * s)) for s in sigma)

    def kernel(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        label = w["label"]
        best, out = np.full(label.shape, -1.0), np.zeros(label.shape, np.int64)
        for c in np.unique(label[label > 0] if not zero else label):
            got = np.round(blurred((label == c).astype(np.float64), *sigma, lambda s: int(round(4 * s)), "reflect"), 9)
            out, best = np.where(got > best, c, out), np.maximum(got, best)
        return {"label": np.where(label == 0, 0, out)}

    return on_blocks(pixels, ["label"], kernel, "label long", block, reach)


def refined(p: np.ndarray, he: np.ndarray, support: np.ndarray, movable: np.ndarray, mpp: tuple[float, float], smoothness: float, rounds: int, blur_um: float, sigma: float) -> np.ndarray:
    """Probabilities after so many steps in which movable cells alone go to the mean of what they were and their neighbours, by the stain. mpp: (y, x)."""
    density = -np.log((he.astype(np.float64) + 1) / 256)
    if blur_um:
        for axis, m in enumerate(mpp):
            r = math.ceil(3 * blur_um / m)
            w = np.exp(-0.5 * (np.arange(-r, r + 1) * m / blur_um) ** 2)
            density = along(density, (w / w.sum()).tolist(), axis, "reflect")
    sides, own = [], np.ones(support.shape)
    for axis in (0, 1):
        a, b = [slice(None)] * 2, [slice(None)] * 2
        a[axis], b[axis] = slice(1, None), slice(None, -1)
        a, b = tuple(a), tuple(b)
        w = smoothness * np.exp(-((density[a] - density[b]) ** 2).sum(axis=2) / (2 * sigma**2)) * (support[a] & support[b])
        sides += [(a, b, w), (b, a, w)]
    for to, _, w in sides:
        own[to] += w
    q = p
    for _ in range(rounds):
        u = p.copy()
        for to, of, w in sides:
            u[to] += w[..., None] * q[of]
        q = np.where(movable[..., None], u / own[..., None], p)
    return q


def refine_boundaries(cells: DataFrame, mpp: tuple[float, float], smoothness: float, rounds: int, sigma: float, margin: float, distance_um: float, blur_um: float = 0.0, block: int = 256, keep_classes: bool = True) -> DataFrame:
    """(key, label, raw, movable) of cells (image_id, y, x, p array, r, g, b, support): only cells near a border between classes, and unsure, move.

    raw: the first largest probability's class, from 1; 0 off the support. Movable are cells of the support whose two largest
    probabilities differ by `margin` at most, and that are no farther than distance_um from a cell at a border inside the support. A block without
    any is passed through, the others get a halo of all that a cell depends on, so blocks don't show. mpp: (x, y). With keep_classes it is an
    error if a class vanishes from an image.
    """
    p = F.col("p")
    two = F.slice(F.sort_array(p, False), 1, 2)
    first = F.array_position(p, F.array_max(p)).cast("long")
    at = stash(cells.select(*grid.KEY, "p", "r", "g", "b", "support", F.when(F.col("support"), first).otherwise(0).alias("raw"), (two[0] - two[1]).alias("margin")))
    border = grid.interface_pixels(at.where("raw > 0"), "raw")
    near = grid.distances(at.where((F.col("raw") > 0) & (F.col("margin") <= margin)).select(*grid.KEY), border, mpp[0], mpp[1]).where(F.col("d") <= distance_um)
    at = at.join(near.select(*grid.KEY, F.lit(True).alias("movable")), list(grid.KEY), "left").withColumn("movable", F.coalesce("movable", F.lit(False)))

    def kernel(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        movable, label = w["movable"].astype(bool), w["raw"].astype(np.int64)
        if movable.any():
            q = refined(w["p"], np.stack([w[c] for c in "rgb"], axis=2), w["support"].astype(bool) & w["there"], movable, (mpp[1], mpp[0]), smoothness, rounds, blur_um, sigma)
            label = np.where(movable, q.argmax(axis=2) + 1, label)
        return {"label": label, "raw": w["raw"], "movable": movable}

    halo = max(math.ceil(3 * blur_um / m) for m in mpp) + rounds + 1
    out = stash(on_blocks(at, ["p", "r", "g", "b", "support", "raw", "movable"], kernel, "label long, raw long, movable boolean", block, halo))
    if keep_classes and not out.select("image_id", "raw").distinct().join(out.select("image_id", F.col("label").alias("raw")).distinct(), ["image_id", "raw"], "left_anti").isEmpty():
        raise ValueError("a class would vanish")
    return out
