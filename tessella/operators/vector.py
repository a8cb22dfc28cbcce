"""Rings from label rasters and back: pixel-edge polygons, areas, rasterization, round trips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.components import label_components
from tessella.operators.grid import KEY
from tessella.plans.durable import stash

RINGS = "image_id string, component long, label long, ring int, hole boolean, points array<struct<x:double,y:double>>"
POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
RING_ROWS = pa.schema([("image_id", pa.string()), ("component", pa.int64()), ("label", pa.int64()), ("hole", pa.bool_()), ("points", POINTS)])
BORDERED = pa.schema([*RING_ROWS, *((c, pa.int64()) for c in ("y0", "x0", "y1", "x1"))])


def _after(c: np.ndarray, y0: np.ndarray, x0: np.ndarray, y1: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next edge, whether there is one) of unit edges in order of (c, y0, x0, y1, x1), c counting from 0; at a crossing the turn to the right."""
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    low_y, low_x = np.minimum(np.minimum.reduceat(y0, first), np.minimum.reduceat(y1, first)), np.minimum(np.minimum.reduceat(x0, first), np.minimum.reduceat(x1, first))
    tall, wide = (np.maximum(np.maximum.reduceat(p, first), np.maximum.reduceat(q, first)) - low + 1 for p, q, low in ((y0, y1, low_y), (x0, x1, low_x)))
    base = np.cumsum(tall * wide) - tall * wide
    place = lambda y, x: base[c] + (y - low_y[c]) * wide[c] + x - low_x[c]  # noqa: E731  the corners' boxes, one component's behind another's
    at, to = place(y0, x0), place(y1, x1)
    out = np.minimum(np.searchsorted(at, to), len(at) - 1)
    also = np.minimum(out + 1, len(at) - 1)
    dy, dx = y1 - y0, x1 - x0
    left = (at[also] == to) & (also > out) & ~((dy[out] == dx) & (dx[out] == -dy)) & (dy[also] == dx) & (dx[also] == -dy)  # right of the way comes, y grows downwards
    return np.where(left, also, out), at[out] == to


def _traced(image: pa.Array, component: np.ndarray, label: np.ndarray, y0: np.ndarray, x0: np.ndarray, y1: np.ndarray, x1: np.ndarray) -> pa.Table:
    """The rings of unit edges in order of (image, component, y0, x0, y1, x1), each from its first corner, straight runs joined."""
    if not len(component):
        return RING_ROWS.empty_table()
    codes = image.dictionary_encode().indices.to_numpy()
    c = np.cumsum(np.concatenate(([0], (component[1:] != component[:-1]) | (codes[1:] != codes[:-1]))))
    follows, _ = _after(c, y0, x0, y1, x1)
    root, hop = np.arange(len(c)), follows
    while ((low := np.minimum(root, root[hop])) != root).any():  # the first edge of each ring, by pointer doubling
        root, hop = low, hop[hop]
    last = follows == root
    left, hop = (~last).astype(np.int64), np.where(last, np.arange(len(c)), follows)
    while (more := left[hop]).any():  # edges up to the ring's last one
        left, hop = left + more, hop[hop]
    order = np.lexsort((-left, root))
    y0, x0, y1, x1 = (v[order] for v in (y0, x0, y1, x1))
    heads = np.flatnonzero(np.concatenate(([True], root[order][1:] != root[order][:-1])))
    dy, dx = y1 - y0, x1 - x0
    ends = np.append(heads[1:], len(c)) - 1
    came_y, came_x = np.roll(dy, 1), np.roll(dx, 1)
    came_y[heads], came_x[heads] = dy[ends], dx[ends]
    turns = (dy != came_y) | (dx != came_x)
    hole = np.add.reduceat(x0 * y1 - x1 * y0, heads) < 0
    points = np.add.reduceat(turns.astype(np.int64), heads)
    offsets = np.concatenate(([0], np.cumsum(points + 1)))
    corner = np.flatnonzero(turns)
    pick = np.empty(offsets[-1], np.int64)
    pick[np.arange(len(corner)) + np.repeat(np.arange(len(heads)), points)] = corner
    pick[offsets[1:] - 1] = pick[offsets[:-1]]  # rings are closed
    rows = order[heads]
    xy = pa.StructArray.from_arrays([pa.array(x0[pick].astype(np.float64)), pa.array(y0[pick].astype(np.float64))], ["x", "y"])
    return pa.table([image.take(pa.array(rows)), component[rows], label[rows], hole, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), xy)], schema=RING_ROWS)


def _columns(t: pa.Table) -> tuple:
    whole = lambda c: t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0)
    return whole("image_id"), *(whole(n).to_numpy(zero_copy_only=False) for n in t.column_names[1:])


def _bordered(block: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        """A block's rings that touch none of its borders, and the unit edges of the others; on a border each side's edges are there."""
        image, component, label, y, x = _columns(t)
        top, low = key[1].as_py() * block, key[2].as_py() * block
        names, code = np.unique(component, return_inverse=True)
        held = np.full((block + 2, block + 2), -1, np.int64)
        held[y - top + 1, x - low + 1] = code
        sides = []
        for dy, dx, (ay, ax), (by, bx) in ((-1, 0, (0, 0), (0, 1)), (0, 1, (0, 1), (1, 1)), (1, 0, (1, 1), (1, 0)), (0, -1, (1, 0), (0, 0))):  # clockwise, the inside to the right
            own = np.flatnonzero(held[y - top + 1 + dy, x - low + 1 + dx] != code)
            sides.append((own, y[own] + ay, x[own] + ax, y[own] + by, x[own] + bx))
        own, *e = (np.concatenate(v) for v in zip(*sides, strict=True))
        order = np.lexsort((e[3], e[2], e[1], e[0], code[own]))
        own, (y0, x0, y1, x1) = own[order], (v[order] for v in e)
        c = np.cumsum(np.concatenate(([0], np.diff(code[own]) != 0)))
        follows, there = _after(c, y0, x0, y1, x1)
        open_ = ~there | (y1 == top) | (y1 == top + block) | (x1 == low) | (x1 == low + block)
        hop = np.where(open_, np.arange(len(c)), follows)
        while ((now := open_ | open_[hop]) != open_).any():  # what leads to a border
            open_, hop = now, hop[hop]
        inner = ~open_
        rings = _traced(image.take(pa.array(own[inner])), component[own[inner]], label[own[inner]], *(v[inner] for v in (y0, x0, y1, x1)))
        rest = [image.take(pa.array(own[open_])), component[own[open_]], label[own[open_]], *(v[open_] for v in (y0, x0, y1, x1))]
        blank = lambda n, kind: pa.nulls(n, kind)
        edges = pa.table([*rest[:3], blank(len(rest[1]), pa.bool_()), blank(len(rest[1]), POINTS), *rest[3:]], schema=BORDERED)
        closed = pa.table([*rings.columns, *(blank(len(rings), pa.int64()) for _ in range(4))], schema=BORDERED)
        return pa.concat_tables([closed, edges])

    return run


EDGES_AT_ONCE = 1 << 18  # edges traced together, and one more component


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rings of a partition's edges, in order of their components."""
    held: list[pa.RecordBatch] = []

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        return iter(_traced(*_columns(t)).combine_chunks().to_batches(max_chunksize=10_000))

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= EDGES_AT_ONCE:
            t = pa.Table.from_batches(held)
            own = pc.and_(pc.equal(t["component"], t["component"][-1]), pc.equal(t["image_id"], t["image_id"][-1]))
            cut = pc.index(own, pa.scalar(True)).as_py()  # the last component may go on
            if cut:
                yield from done(t.slice(0, cut))
            held = t.slice(cut).to_batches()
    if sum(map(len, held)):
        yield from done(pa.Table.from_batches(held))


def polygonize(labelled: DataFrame, block: int = 256) -> DataFrame:
    """(image_id, component, label, ring, hole, points): closed rings of each component along pixel edges.

    Outer rings run clockwise (y down), holes the other way; each begins at its first corner, and `ring` counts a component's in that order. At a crossing
    the turn to the right is taken. Blocks trace the rings that touch none of their borders; of the others the unit edges, less those that cancel
    across a border, meet in one task for each component, many components in one.
    """
    keyed = labelled.select("image_id", F.col("component").cast("long").alias("component"), F.col("label").cast("long").alias("label"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    keyed = keyed.withColumns({"by": F.floor(F.col("y") / block), "bx": F.floor(F.col("x") / block)})
    cells = lambda key, t: _bordered(block)(key, t.select(["image_id", "component", "label", "y", "x"]))
    parts = stash(keyed.groupBy("image_id", "by", "bx").applyInArrow(cells, "image_id string, component long, label long, hole boolean, points array<struct<x:double,y:double>>, y0 long, x0 long, y1 long, x1 long"), cells=True)
    low = [F.least("y0", "y1"), F.least("x0", "x1"), F.col("y0") == F.col("y1")]
    ends = ["y0", "x0", "y1", "x1"]
    e = parts.where("points is null").groupBy("image_id", "component", "label", *(k.alias(f"k{i}") for i, k in enumerate(low))).agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in ends))
    e = e.where("n = 1").select("image_id", "component", "label", *ends)
    crossing = e.repartition("image_id", "component").sortWithinPartitions("image_id", "component", *ends).mapInArrow(_followed, "image_id string, component long, label long, hole boolean, points array<struct<x:double,y:double>>")
    rings = parts.where("points is not null").select("image_id", "component", "label", "hole", "points").unionByName(crossing)
    first = F.col("points")[0]
    order = Window.partitionBy("image_id", "component").orderBy(first["y"], first["x"])
    return rings.select("image_id", "component", "label", (F.row_number().over(order) - 1).alias("ring"), "hole", "points")


def ring_area(points: str | Column) -> Column:
    """Signed shoelace area of a closed ring; positive for outer rings here."""
    p = F.col(points) if isinstance(points, str) else points
    pairs = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / 2


def drop_small(rings: DataFrame, part: float, hole: float) -> DataFrame:
    """Rings without components whose outer ring, and holes whose own ring, is strictly smaller than the limit."""
    sized = rings.withColumn("area_", F.abs(ring_area("points")))
    gone = sized.where(~F.col("hole") & (F.col("area_") < part)).select("image_id", "component")
    return sized.where(~F.col("hole") | (F.col("area_") >= hole)).join(gone, ["image_id", "component"], "left_anti").drop("area_")


def scaled(points: str, factor_x: float, factor_y: float) -> Column:
    """A ring's points in another spacing."""
    return F.transform(points, lambda p: F.struct((p["x"] * factor_x).alias("x"), (p["y"] * factor_y).alias("y")))


def polygons(rings: DataFrame) -> DataFrame:
    """(image_id, component, label, coordinates): one polygon a component, its outer ring first, its holes behind it, by `ring` where the rings have that column."""
    ring = F.transform("points", lambda p: F.array(p["x"], p["y"]))
    order = ["hole", "ring"] if "ring" in rings.columns else ["hole"]
    every = rings.groupBy("image_id", "component", "label").agg(F.array_sort(F.collect_list(F.struct(*order, ring.alias("ring_points")))).alias("r"))
    return every.select("image_id", "component", "label", F.transform("r", lambda r: r["ring_points"]).alias("coordinates"))


def feature_json(points: str, label: str) -> Column:
    """A GeoJSON polygon feature of one ring."""
    return _feature(F.array(F.transform(points, lambda p: F.array(p["x"], p["y"]))), label)


def polygon_json(coordinates: str, label: str) -> Column:
    """A GeoJSON polygon feature of an outer ring and its holes."""
    return _feature(F.col(coordinates), label)


def _feature(coordinates: Column, label: str) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(F.col(label).alias("class_id")).alias("properties")))


def rasterize(rings: DataFrame) -> DataFrame:
    """(key, component, label): pixels whose centres are inside a component's rings, by the even-odd rule.

    Each ring edge names the rows whose centre line it crosses; a row's crossings, sorted, pair up to runs of pixels. The
    exchange is keyed by component and row, so a large component spreads over many tasks.
    """
    p = F.col("points")
    edges = rings.select("image_id", "component", "label", F.explode(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))).alias("e")).select("image_id", "component", "label", "e.*")
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.ceil(low - 0.5).cast("long"), (F.ceil(high - 0.5) - 1).cast("long")
    crossed = edges.where(F.col("y0") != F.col("y1")).where(first <= last).select("image_id", "component", "label", "x0", "y0", "x1", "y1", F.explode(F.sequence(first, last)).alias("y"))
    cut = F.col("x0") + (F.col("y") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    rows = crossed.groupBy("image_id", "component", "label", "y").agg(F.array_sort(F.collect_list(cut)).alias("c"))
    runs = F.transform(F.sequence(F.lit(0), F.expr("cast(size(c) div 2 as int)") - 1), lambda i: F.struct(F.ceil(F.get("c", 2 * i) - 0.5).cast("long").alias("a"), (F.ceil(F.get("c", 2 * i + 1) - 0.5) - 1).cast("long").alias("b")))
    spans = rows.select("image_id", "component", "label", "y", F.explode(runs).alias("r")).where("r.a <= r.b")
    return spans.select("image_id", "y", F.explode(F.sequence("r.a", "r.b")).alias("x"), "component", "label")


def dissolve(rings: DataFrame, block: int = 256) -> DataFrame:
    """Rings of the union of touching polygons of one class; polygons of different classes that overlap are an error.

    The union is taken on cells, so cuts between polygons go and holes stay as they are.
    """
    cells = rasterize(rings).groupBy(*KEY).agg(F.min("label").alias("label"), F.max("label").alias("high"))
    one = F.when(F.col("label") == F.col("high"), F.col("label")).otherwise(F.raise_error(F.lit("polygons of different classes overlap")))
    return polygonize(label_components(cells.select(*KEY, one.alias("label")), "label", block=block))


def round_trip_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b): cells in which two sparse label rasters (key, label) differ; a missing cell is 0."""
    left, right = a.select(*KEY, F.col("label").alias("a")), b.select(*KEY, F.col("label").alias("b"))
    return left.join(right, list(KEY), "full").select(*KEY, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")).where("a <> b")
