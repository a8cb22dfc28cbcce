"""Kernels on blocks with a halo: one exchange brings each block its neighbours' cells, numpy does any number of steps inside."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def on_blocks(cells: DataFrame, columns: Sequence[str], kernel: Kernel, out: str, block: int, halo: int, extra: Sequence[str] = (), frame: tuple[int, int] | None = None) -> DataFrame:
    """(key, *extra, *out): the kernel's results on each cell (image_id, y, x, *extra, *columns) that it gets with all cells up to `halo` away.

    Every cell goes to the blocks in whose halo it lies, so the one exchange moves (1 + 2 * halo / block) ** 2 cells for each, and
    nothing else does. extra: columns whose values are layers apart. kernel: arrays by column over the window, `there` tells the
    cells that exist; it returns arrays of the same window, of which the core stays. A window ends where the frame (height,
    width) does, or without one where the cells do.
    """
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / block), F.floor((F.col(c) + halo) / block)))
    dealt = cells.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *extra, *columns).withColumn("by_", span("y")).withColumn("bx_", span("x"))
    names = [f.split()[0] for f in out.split(", ")]
    layers = list(extra)
    kinds = "".join(f"{c} {cells.schema[c].dataType.simpleString()}, " for c in layers)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        core = (y // block == key[-2]) & (x // block == key[-1])
        if not core.any():
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("image_id", "y", "x", *layers, *names)})
        if frame:
            low, high = ([f(k * block) for k in key[-2:]] for f in (lambda v: max(0, v - halo), lambda v: v + block + halo))
            y0, x0 = low
            shape = tuple(min(n, h) - v for n, h, v in zip(frame, high, low, strict=True))
        else:
            y0, x0 = y.min(), x.min()
            shape = (y.max() - y0 + 1, x.max() - x0 + 1)
        window = {"there": np.zeros(shape, bool)}
        window["there"][y - y0, x - x0] = True
        for c in columns:
            v = pdf[c].to_numpy()
            v = np.stack(v) if len(v) and isinstance(v[0], (np.ndarray, list)) else v
            window[c] = np.zeros((*shape, *v.shape[1:]), v.dtype if v.dtype != object else float)
            window[c][y - y0, x - x0] = v
        got = kernel(window)
        y, x = y[core], x[core]
        values = {n: got[n][y - y0, x - x0] for n in names}
        same = {"image_id": np.full(len(y), key[0], object), "y": y, "x": x, **{c: np.full(len(y), v) for c, v in zip(layers, key[1:-2], strict=True)}}
        return pd.DataFrame({**same, **{n: v if v.ndim == 1 else list(v) for n, v in values.items()}})

    return dealt.groupBy("image_id", *layers, "by_", "bx_").applyInPandas(run, f"image_id string, y long, x long, {kinds}{out}")


def along(a: np.ndarray, weights: Sequence[float], axis: int, edge: str) -> np.ndarray:
    """One pass of a filter along an axis; edge as numpy names it (`reflect` doesn't repeat the edge cell, `symmetric` and `edge` do)."""
    r, n = len(weights) // 2, a.shape[axis]
    pad = [(0, 0)] * a.ndim
    pad[axis] = (r, r)
    wide = np.pad(a, pad, mode="edge" if n == 1 else edge)
    return sum(w * np.take(wide, range(k, k + n), axis) for k, w in enumerate(weights))
