"""Fields on grids: sparse symmetric systems solved by conjugate gradients over blocks, and appearance scores from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.grid import KEY, area_resample, bilinear
from tessella.operators.stencil import on_blocks
from tessella.plans.durable import stash

FIELD_UM, LENGTH_UM, PRIOR, CONTRAST, FLOOR = 8.0, 16.0, 0.015, 0.1, 0.02  # of the field's cells; of its smoothness; of its prior; of densities; of conductances. Fixed values.
SPREAD_FLOOR, DIAGONAL, RIDGE = 0.05, 0.2, 0.0025  # of a channel's deviation; share of the diagonal alone; added to it. Fixed values.
BLOCK, TOLERANCE, ROUNDS = 32, 1e-9, 300

PACKED = "system string, by long, bx long, y0 long, x0 long, h int, w int, k int, fixed binary, state binary, gamma array<double>, alpha array<double>, top double"


def conductances(cells: DataFrame, guide: str, spacing: tuple[float, float], length: float, contrast: float = CONTRAST, floor: float = FLOOR, block: int = 256) -> DataFrame:
    """(key, right, left, down, up): how strongly a cell is tied to each neighbour, 0 where there is none.

    guide: an array a cell; neighbours alike in it are tied fully, by (length / spacing) squared, others down to the floor.
    spacing: (y, x). One exchange, with a halo of a cell.
    """
    def kernel(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        g, there, out = w[guide], w["there"], {n: np.zeros(w["there"].shape) for n in ("right", "left", "down", "up")}
        for axis, (ahead, back) in enumerate((("down", "up"), ("right", "left"))):
            a, b = [slice(None)] * 2, [slice(None)] * 2
            a[axis], b[axis] = slice(None, -1), slice(1, None)
            a, b = tuple(a), tuple(b)
            like = floor + np.exp(-((g[a] - g[b]) ** 2).sum(axis=2) / (2 * contrast**2))
            out[ahead][a] = out[back][b] = (length / spacing[axis]) ** 2 * like * (there[a] & there[b])
        return out

    return on_blocks(cells, [guide], kernel, "right double, left double, down double, up double", block, 1)


def _blocks(k: int):
    """A block's cells as packed arrays: ties, diagonal and right sides; a cell that isn't there stands alone."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        y0, x0 = int(y.min()), int(x.min())
        h, w = int(y.max()) - y0 + 1, int(x.max()) - x0 + 1
        fixed, rhs = np.zeros((6, h, w)), np.zeros((k, h, w))
        fixed[4] = 1.0
        for i, c in enumerate(("right", "left", "down", "up", "diagonal")):
            fixed[i, y - y0, x - x0] = pdf[c].to_numpy()
        fixed[5, y - y0, x - x0] = 1.0
        rhs[:, y - y0, x - x0] = np.stack(pdf["rhs"]).T
        state = np.zeros((6, k, h, w))  # x, r, p, s, z, w
        state[1] = rhs
        return pd.DataFrame([(key[0], key[1], key[2], y0, x0, h, w, k, fixed.tobytes(), state.tobytes(), [0.0] * k, [0.0] * k, float(np.abs(rhs).max()))], columns=[c.split()[0] for c in PACKED.split(", ")])

    return run


def _inverse(fixed: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The block's own part of the system, solved: what the iteration is preconditioned by."""
    k, h, w = r.shape
    n, at = h * w, np.arange(h * w).reshape(h, w)
    a = np.zeros((n, n))
    a[np.arange(n), np.arange(n)] = fixed[:5].sum(axis=0).ravel()
    for c, i, j in ((0, at[:, :-1], at[:, 1:]), (2, at[:-1], at[1:])):
        tie = fixed[c][: i.shape[0], : i.shape[1]].ravel()
        a[i.ravel(), j.ravel()] -= tie
        a[j.ravel(), i.ravel()] -= tie
    return np.linalg.solve(a, r.reshape(k, n).T).T.reshape(k, h, w)


def _rows(batches: Iterator[pa.RecordBatch], fit, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pylist([fit(row)], schema=schema)


def _advance(row: dict) -> dict:
    """The step along the direction that the sums of all blocks give, and the residual preconditioned anew."""
    shape = (row["k"], row["h"], row["w"])
    fixed, (x, r, p, s, z, w) = np.frombuffer(row["fixed"]).reshape(6, *shape[1:]), np.frombuffer(row["state"]).reshape(6, *shape).copy()
    if row["sums"] is not None:
        new, delta = (np.array([v[c] for v in row["sums"]]) for c in ("gamma", "delta"))
        old, alpha = np.array(row["gamma"]), np.array(row["alpha"])
        beta = np.divide(new, old, out=np.zeros_like(new), where=old > 0)
        below = delta - np.divide(beta * new, alpha, out=np.zeros_like(new), where=alpha != 0)
        alpha = np.divide(new, below, out=np.zeros_like(new), where=below > 0)
        p, s = z + beta[:, None, None] * p, w + beta[:, None, None] * s
        x, r = x + alpha[:, None, None] * p, r - alpha[:, None, None] * s
        row["gamma"], row["alpha"] = new.tolist(), alpha.tolist()
    z = _inverse(fixed, r)
    return {**{c: row[c] for c in ("system", "by", "bx", "y0", "x0", "h", "w", "k", "fixed", "gamma", "alpha", "top")}, "state": np.stack((x, r, p, s, z, w)).tobytes(), "left": float(np.abs(r).max())}


def _apply(row: dict) -> dict:
    """The system times the preconditioned residual, the neighbours' edges at hand, and this block's share of the sums."""
    k, h, w_ = row["k"], row["h"], row["w"]
    fixed, state = np.frombuffer(row["fixed"]).reshape(6, h, w_), np.frombuffer(row["state"]).reshape(6, k, h, w_).copy()
    z = state[4]
    wide = np.zeros((k, h + 2, w_ + 2))
    wide[:, 1:-1, 1:-1] = z
    for e in row["edges"] or ():
        got = np.frombuffer(e["z"]).reshape(k, -1)
        first, n = e["first"] - (row["x0"] if e["side"] in "du" else row["y0"]), got.shape[1]
        keep = slice(max(0, -first), n - max(0, first + n - (w_ if e["side"] in "du" else h)))
        place = slice(1 + first + keep.start, 1 + first + keep.stop)
        line = {"l": np.s_[:, place, 0], "r": np.s_[:, place, -1], "u": np.s_[:, 0, place], "d": np.s_[:, -1, place]}[e["side"]]
        wide[line] = got[:, keep]
    w = fixed[:5].sum(axis=0) * z - fixed[0] * wide[:, 1:-1, 2:] - fixed[1] * wide[:, 1:-1, :-2] - fixed[2] * wide[:, 2:, 1:-1] - fixed[3] * wide[:, :-2, 1:-1]
    state[5] = w
    return {**{c: row[c] for c in ("system", "by", "bx", "y0", "x0", "h", "w", "k", "fixed", "gamma", "alpha", "top")}, "state": state.tobytes(), "part": [{"gamma": float((a * b).sum()), "delta": float((c * b).sum())} for a, b, c in zip(state[1], z, w, strict=True)]}


def _edges(row: dict) -> list[dict]:
    """A block's outer lines for its four neighbours, named by the side on which they find it."""
    k, h, w = row["k"], row["h"], row["w"]
    z = np.frombuffer(row["state"]).reshape(6, k, h, w)[4]
    sides = ((0, -1, "r", z[:, :, 0], "y0"), (0, 1, "l", z[:, :, -1], "y0"), (-1, 0, "d", z[:, 0], "x0"), (1, 0, "u", z[:, -1], "x0"))
    return [{"system": row["system"], "by": row["by"] + dy, "bx": row["bx"] + dx, "side": side, "first": row[first], "z": np.ascontiguousarray(v).tobytes()} for dy, dx, side, v, first in sides]


def solve(cells: DataFrame, block: int = BLOCK, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """(system, y, x, u array): u with (diagonal + ties) u - sum of ties * neighbours' u = rhs, of cells (system, y, x, right, left, down, up, diagonal, rhs array).

    Conjugate gradients, preconditioned by each block's own part of the system (so a grid of one block is solved at once). A
    round sends every block the lines beside it and sums two products; blocks travel as packed arrays and are gathered
    nowhere. Ends when the residual is `tolerance` of the largest right side in every system; an error after too many rounds.
    """
    first = cells.select("rhs").first()
    if first is None:
        return cells.select("system", "y", "x", F.col("rhs").alias("u"))
    k = len(first[0])
    base = {f.split()[0]: f.split()[1] for f in PACKED.split(", ")}
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    fields = [pa.field(n, arrow[t]) for n, t in base.items()]
    part = pa.list_(pa.struct([("gamma", pa.float64()), ("delta", pa.float64())]))
    moved, applied = pa.schema([*fields, pa.field("left", pa.float64())]), pa.schema([*fields, pa.field("part", part)])
    edge = pa.schema([("system", pa.string()), ("by", pa.int64()), ("bx", pa.int64()), ("side", pa.string()), ("first", pa.int64()), ("z", pa.binary())])

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(_edges(row), schema=edge)

    lined = cells.withColumns({"by": F.floor(F.col("y") / block), "bx": F.floor(F.col("x") / block)})
    at = stash(lined.groupBy("system", "by", "bx").applyInPandas(_blocks(k), PACKED))
    tops = stash(at.groupBy("system").agg(F.max("top").alias("most")))
    sums = None
    for _ in range(rounds):
        if sums is None:
            at = at.withColumn("sums", F.lit(None).cast("array<struct<gamma:double,delta:double>>"))
        else:
            at = at.join(sums, "system")
        at = stash(at.mapInArrow(lambda b: _rows(b, _advance, moved), f"{PACKED}, left double"))
        over = at.groupBy("system").agg(F.max("left").alias("left")).join(tops, "system").where(F.col("left") > tolerance * F.col("most"))
        if sums is not None and over.isEmpty():
            break
        lines = at.mapInArrow(out, "system string, by long, bx long, side string, first long, z binary").groupBy("system", "by", "bx").agg(F.collect_list(F.struct("side", "first", "z")).alias("edges"))  # four at most
        at = stash(at.join(lines, ["system", "by", "bx"], "left").mapInArrow(lambda b: _rows(b, _apply, applied), f"{PACKED}, part array<struct<gamma:double,delta:double>>"))
        each = at.select("system", F.posexplode("part").alias("i", "p")).groupBy("system", "i").agg(F.sum("p.gamma").alias("gamma"), F.sum("p.delta").alias("delta"))
        sums = each.groupBy("system").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "gamma", "delta"))), lambda v: F.struct(v["gamma"].alias("gamma"), v["delta"].alias("delta"))).alias("sums"))
    else:
        raise RuntimeError("the field did not settle")

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                there = np.frombuffer(row["fixed"]).reshape(6, row["h"], row["w"])[5] > 0
                y, x = np.nonzero(there)
                u = np.frombuffer(row["state"]).reshape(6, row["k"], row["h"], row["w"])[0][:, y, x].T
                yield pa.RecordBatch.from_arrays([pa.array([row["system"]] * len(y)), pa.array(y + row["y0"]), pa.array(x + row["x0"]), pa.array(list(u), pa.list_(pa.float64()))], ["system", "y", "x", "u"])

    return at.mapInArrow(cells_of, "system string, y long, x long, u array<double>")


def class_colours(cells: DataFrame) -> DataFrame:
    """(image_id, mean by class, precision) of cells (image_id, label > 0, weight, v array of three): one row an image.

    Means are weighted; the covariance about them is pooled over the classes on channels scaled by their deviation, shared
    with its diagonal, and inverted. The sums are aggregated by class and channel pair.
    """
    v = [F.col("v")[i] for i in range(3)]
    used = cells.where("label > 0 and weight > 0")
    spread = used.groupBy("image_id").agg(*(F.greatest(F.stddev_pop(v[i]), F.lit(SPREAD_FLOOR)).alias(f"s{i}") for i in range(3)))
    per = used.groupBy("image_id", "label").agg(F.sum("weight").alias("n"), *(F.sum(F.col("weight") * v[i]).alias(f"m{i}") for i in range(3)), *(F.sum(F.col("weight") * v[i] * v[j]).alias(f"q{i}{j}") for i in range(3) for j in range(i, 3)))

    def run(key: tuple, classes: pd.DataFrame, spread: pd.DataFrame) -> pd.DataFrame:
        classes = classes.sort_values("label")
        scale, n = spread[[f"s{i}" for i in range(3)]].to_numpy()[0], classes["n"].to_numpy()
        mean = classes[[f"m{i}" for i in range(3)]].to_numpy() / n[:, None]
        c = np.zeros((3, 3))
        for i in range(3):
            for j in range(i, 3):
                c[i, j] = c[j, i] = (classes[f"q{i}{j}"].to_numpy() - n * mean[:, i] * mean[:, j]).sum() / n.sum() / scale[i] / scale[j]
        c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(3)
        return pd.DataFrame([(key[0], classes["label"].tolist(), mean.tolist(), np.linalg.inv(c * np.outer(scale, scale)).ravel().tolist())], columns=["image_id", "labels", "means", "precision"])

    return per.groupBy("image_id").cogroup(spread.groupBy("image_id")).applyInPandas(run, "image_id string, labels array<long>, means array<array<double>>, precision array<double>")  # a row a class


def appearance(cells: DataFrame, shape: tuple[int, int], mpp: tuple[float, float], field_um: float = FIELD_UM, length_um: float = LENGTH_UM, prior: float = PRIOR, contrast: float = CONTRAST, floor: float = FLOOR, block: int = BLOCK) -> DataFrame:
    """(key, label, p): of each cell the likeliest class by its colour against the classes' fields, and its probability.

    cells: (image_id, y, x, v array of three values, weight, label (0: unknown), r, g, b), dense, shape (height, width), mpp (x, y).
    A class's field is smooth where the stain is, and follows its cells' values where they have weight, elsewhere its mean.
    It is solved on cells of about field_um, interpolated back, and the values' distances from it are weighed by the
    classes' pooled covariance. An image of one class has it everywhere.
    """
    h, w = shape
    fh, fw = (max(2, math.ceil(n * m / field_um)) for n, m in ((h, mpp[1]), (w, mpp[0])))
    spacing = (mpp[1] * h / fh, mpp[0] * w / fw)
    stats = stash(class_colours(cells))
    sides = ((fh, fw), (h, w))
    guide = area_resample(cells, ["r", "g", "b"], *sides).select(*KEY, F.array(*(-F.log((F.round(c) + 1) / 256) for c in ("r", "g", "b"))).alias("guide"))
    ties = stash(conductances(guide, "guide", spacing, length_um, contrast, floor))
    classes = stats.select("image_id", F.explode(F.arrays_zip("labels", "means")).alias("c")).select("image_id", F.col("c.labels").alias("k"), F.col("c.means").alias("mean"))
    own = cells.where("label > 0 and weight > 0").select(*KEY, F.col("label").alias("k"), F.col("weight").alias("m"), *((F.col("weight") * F.col("v")[i]).alias(f"s{i}") for i in range(3)))
    part = (h * w) / (fh * fw)  # cells of the fine grid in one of the field, of which the area means divide the sums
    held = _area_sums(own, ["m", "s0", "s1", "s2"], *sides, ("k",))
    rows = ties.join(classes, "image_id").join(held, [*KEY, "k"], "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / part
    rows = rows.select(F.concat_ws("/", "image_id", F.col("k").cast("string")).alias("system"), "image_id", "k", "y", "x", "right", "left", "down", "up", (share("m") + prior).alias("diagonal"), F.array(*(share(f"s{i}") + prior * F.col("mean")[i] for i in range(3))).alias("rhs"))
    rows = stash(rows)
    names = rows.select("system", "image_id", "k").distinct()
    fields = stash(solve(rows, block).join(names, "system").select(*KEY, "k", "u"))
    long = fields.select(*KEY, "k", F.posexplode("u").alias("i", "u"))
    back = bilinear(long, "u", fh, fw, (fh / h, fw / w), cells.select(*KEY), ("k", "i")).groupBy(*KEY, "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "u"))), lambda s: s["u"]).alias("u"))
    met = back.join(cells.select(*KEY, "v"), list(KEY)).join(stats.select("image_id", "precision"), "image_id")
    d = [F.col("v")[i] - F.col("u")[i] for i in range(3)]
    score = -0.5 * sum(d[i] * d[j] * F.col("precision")[3 * i + j] for i in range(3) for j in range(3))
    best = met.select(*KEY, "k", score.alias("score")).groupBy(*KEY).agg(F.max(F.struct("score", (-F.col("k")).alias("n"))).alias("b"), F.collect_list("score").alias("all"))
    return best.select(*KEY, (-F.col("b.n")).alias("label"), (1 / F.aggregate("all", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("b.score")))).alias("p"))


def _area_sums(cells: DataFrame, values: list[str], source: tuple[int, int], target: tuple[int, int], extra: tuple[str, ...]) -> DataFrame:
    """(key, *extra, values): sums over target cells, each cell's value dealt by its overlap with them in shares of its own area."""
    def spans(c: str, s: int, t: int):
        lo, hi = F.col(c) * s, (F.col(c) + 1) * s
        return F.transform(F.sequence(F.floor(lo / t), F.floor((hi - 1) / t)), lambda i: F.struct(i.alias("t"), ((F.least(hi, (i + 1) * t) - F.greatest(lo, i * t)) / s).alias("n")))

    e = cells.select("image_id", *extra, F.explode(spans("y", source[0], target[0])).alias("a_"), "x", *values).select("image_id", *extra, "a_", F.explode(spans("x", source[1], target[1])).alias("b_"), *values)
    w = F.col("a_.n") * F.col("b_.n")
    return e.groupBy("image_id", F.col("a_.t").alias("y"), F.col("b_.t").alias("x"), *extra).agg(*(F.sum(w * F.col(v)).alias(v) for v in values))
