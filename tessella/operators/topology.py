"""Planar topology of label rasters: shared arcs between junctions, each simplified once; faces stitched from arcs."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import ranked
from tessella.plans.durable import stash

OUTSIDE = -1  # the region beside a raster's cells
ROW = 1 << 30  # of an arc's name
LONG = 50_000  # corners of an arc that one task simplifies
CELL = 64  # side of an index cell
STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0))  # (dy, dx) by direction; the next one turns right, y grows downwards

CHAINS = "image_id string, chain long, n long, closed boolean, y0 long, x0 long, y1 long, x1 long, d0 int, d1 int, left long, right long, area2 long, points array<struct<pos:long,y:long,x:long>>"


def region_edges(labelled: DataFrame) -> DataFrame:
    """(image_id, y, x, d, left, right): unit edges between two regions of (image_id, y, x, component).

    An edge runs from the corner (y, x) to the right (d = 0) or down (d = 1); left and right are the regions beside it, OUTSIDE
    where there is no cell. Each cell names its four sides, a side gathers its two cells.
    """
    side = lambda dy, dx, d, right: F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(d).alias("d"), F.lit(right).alias("r"))
    sides = F.array(side(0, 0, 0, True), side(1, 0, 0, False), side(0, 0, 1, False), side(0, 1, 1, True))
    e = labelled.select("image_id", F.col("component").alias("c"), F.explode(sides).alias("e")).select("image_id", "c", "e.*")
    of = lambda r: F.coalesce(F.max(F.when(F.col("r") == r, F.col("c"))), F.lit(OUTSIDE)).cast("long")
    return e.groupBy("image_id", "y", "x", "d").agg(of(False).alias("left"), of(True).alias("right")).where("left <> right")


def _chains(block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block's edges as chains: from corner to corner, on through corners inside the block at which just two edges meet."""
        pdf = pdf.sort_values(["y", "x", "d"], kind="stable")
        y, x, d, left, right = (pdf[c].to_numpy(np.int64).tolist() for c in ("y", "x", "d", "left", "right"))
        u = list(zip(y, x, strict=True))
        v = [(b, a + 1) if k == 0 else (b + 1, a) for b, a, k in zip(y, x, d, strict=True)]
        at: dict[tuple[int, int], list[int]] = {}
        for e in range(len(u)):
            at.setdefault(u[e], []).append(e)
            at.setdefault(v[e], []).append(e)
        through = {p for p, es in at.items() if len(es) == 2 and p[0] % block and p[1] % block}
        used, rows = [False] * len(u), []

        def walk(start: tuple[int, int], e: int) -> None:
            p, n, points, first, last, area2, corner = start, 0, [], None, None, 0, start
            beside = (left[e], right[e]) if u[e] == start else (right[e], left[e])
            name = 2 * (y[e] * ROW + x[e]) + d[e]
            while True:
                used[e] = True
                name = min(name, 2 * (y[e] * ROW + x[e]) + d[e])
                way = d[e] if u[e] == p else d[e] + 2
                if first is None:
                    first = way
                elif way != last:
                    area2 += corner[1] * p[0] - p[1] * corner[0]
                    points.append((n, *p))
                    corner = p
                last = way
                p = v[e] if u[e] == p else u[e]
                n += 1
                if p not in through or p == start:
                    break
                e = next(k for k in at[p] if k != e)
            area2 += corner[1] * p[0] - p[1] * corner[0]
            closed = start in through
            if closed:
                points.insert(0, (0, *start))
            rows.append((name, n, closed, *start, *p, first, last, *beside, area2, [{"pos": k, "y": b, "x": a} for k, b, a in points]))

        for p in sorted(at):
            if p not in through:
                for e in at[p]:
                    if not used[e]:
                        walk(p, e)
        for e in range(len(u)):  # what is left are loops; the first edge of each, in order, leaves its first corner to the right
            if not used[e]:
                walk(u[e], e)
        names = [c.split()[0] for c in CHAINS.split(", ")][1:]
        return pd.DataFrame(rows, columns=names).assign(image_id=pdf["image_id"].iloc[0])[["image_id", *names]]

    return run


class Coverage:
    """arcs (image_id, arc, left, right, length, closed, y0, x0, y1, x1, d0, d1, area2) and their points (image_id, arc, pos, y, x).

    An arc is a maximal line between two regions, from junction to junction (corners at which three or four edges meet), or a
    loop. It starts at the smaller end, a loop at its first corner with its inside to the right; its name is that corner and the first
    direction, so that blocks don't show. points are its ends and the corners at which it turns, pos counts unit edges; a
    loop's first point stands again at its end. area2 is the shoelace sum along it.
    """

    def __init__(self, labelled: DataFrame, block: int = 256):
        """labelled: (image_id, y, x, component). Blocks are walked in tasks; whatever crosses their lines is joined by pointer doubling."""
        edges = region_edges(labelled).withColumns({"by": F.expr(f"y div {block}"), "bx": F.expr(f"x div {block}")})
        chains = stash(edges.groupBy("image_id", "by", "bx").applyInPandas(_chains(block), CHAINS).withColumn("node", F.shiftright(F.xxhash64("image_id", "chain"), 1)))
        end = lambda s, y, x, d: F.struct(F.lit(s).alias("side"), F.col(y).alias("y"), F.col(x).alias("x"), ((d) % 4).cast("int").alias("into"))
        ends = chains.where("not closed").select("image_id", "node", F.explode(F.array(end(0, "y0", "x0", F.col("d0")), end(1, "y1", "x1", F.col("d1") + 2))).alias("e")).select("image_id", "node", "e.*")
        corners = stash(ends.groupBy("image_id", "y", "x").agg(F.collect_list(F.struct("node", "side", "into")).alias("e")).withColumn("two", F.size("e") == 2))  # four at most
        a, b = F.col("e")[0], F.col("e")[1]
        half = lambda e, leaving: e["node"] * 2 + F.when(e["side"] == F.lit(1 if leaving else 0), 0).otherwise(1)
        links = corners.where("two").select(F.explode(F.array(F.struct(half(a, True).alias("node"), half(b, False).alias("next")), F.struct(half(b, True).alias("node"), half(a, False).alias("next")))).alias("l")).select("l.*")
        halves = chains.where("not closed").select(F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node"), F.col("n").alias("weight"))
        rank = ranked(halves.join(links, "node", "left")).withColumns({"way": F.pmod("node", F.lit(2)), "chain_": F.shiftright("node", 1)})
        shape = chains.select(F.col("node").alias("chain_"), "image_id", "y0", "x0", "y1", "x1", "d0", "d1", "left", "right", "area2", "points")
        turned = F.col("way") == 1
        pick = lambda no, yes: F.when(turned, yes).otherwise(no)
        rows = rank.join(shape, "chain_").select(
            "image_id", "chain_", "head", "node", "before", "total", "cyclic", "way", "points", F.col("weight").alias("n"),
            pick(F.col("y0"), F.col("y1")).alias("ya"), pick(F.col("x0"), F.col("x1")).alias("xa"), pick(F.col("y1"), F.col("y0")).alias("yb"), pick(F.col("x1"), F.col("x0")).alias("xb"),
            pick(F.col("d0"), (F.col("d1") + 2) % 4).alias("da"), pick(F.col("d1"), (F.col("d0") + 2) % 4).alias("db"),
            pick(F.col("left"), F.col("right")).alias("left"), pick(F.col("right"), F.col("left")).alias("right"), pick(F.col("area2"), -F.col("area2")).alias("area2"))
        rows = stash(rows)
        last = F.struct("before", "yb", "xb", "db")
        both = rows.groupBy("head").agg(
            F.min("chain_").alias("lowest"), F.first("image_id").alias("image_id"), F.first("cyclic").alias("cyclic"), F.first("total").alias("length"), F.sum("area2").alias("area2"),
            F.max(F.when(F.col("node") == F.col("head"), F.struct("ya", "xa", "da", "left", "right"))).alias("f"), F.max(last).alias("l"))
        prefer = F.struct((F.col("cyclic") & (F.col("area2") < 0)).alias("inverse"), F.col("f.ya"), F.col("f.xa"), F.col("f.da"))
        chosen = stash(both.groupBy("image_id", "lowest").agg(F.min_by(F.struct("head", "cyclic", "length", "area2", "f", "l"), prefer).alias("c")).select("image_id", "c.*"))
        keep = corners.select(F.explode("e").alias("e"), (~F.col("two") | ((F.col("e")[0]["into"] + 2) % 4 != F.col("e")[1]["into"])).alias("bends")).select(F.col("e.node").alias("chain_"), F.col("e.side").alias("side"), "bends")
        own = rows.select("image_id", "head", "chain_", "way", "before", "n", "points", "ya", "xa").join(chosen.select("head"), "head")
        inner = own.select("image_id", "head", F.col("before"), "n", "way", F.explode("points").alias("p")).select("image_id", "head", (F.col("before") + F.when(F.col("way") == 0, F.col("p.pos")).otherwise(F.col("n") - F.col("p.pos"))).alias("pos"), "p.y", "p.x")
        starts = own.withColumn("side", F.col("way").cast("int")).join(keep, ["chain_", "side"]).where("bends").select("image_id", "head", F.col("before").alias("pos"), F.col("ya").alias("y"), F.col("xa").alias("x"))
        stops = chosen.where("not cyclic").select("image_id", "head", F.col("length").alias("pos"), F.col("l.yb").alias("y"), F.col("l.xb").alias("x"))
        loops = chains.where("closed").select("image_id", F.col("node").alias("head"), F.explode("points").alias("p")).select("image_id", "head", "p.*")
        paths = inner.unionByName(starts).unionByName(stops)
        alone = chains.where("closed").select("image_id", F.col("node").alias("head"), F.lit(True).alias("cyclic"), F.col("n").alias("length"), "area2", "left", "right")
        alone = alone.select("image_id", "head", "cyclic", "length", "area2", *(F.lit(None).cast("long").alias(c) for c in ("y0", "x0", "y1", "x1")), *(F.lit(None).cast("int").alias(c) for c in ("d0", "d1")), "left", "right")
        flat = chosen.select("image_id", "head", "cyclic", "length", "area2", F.col("f.ya").alias("y0"), F.col("f.xa").alias("x0"), F.col("l.yb").alias("y1"), F.col("l.xb").alias("x1"), F.col("f.da").alias("d0"), F.col("l.db").alias("d1"), F.col("f.left").alias("left"), F.col("f.right").alias("right"))
        tag = lambda df, k: df.withColumn("kind", F.lit(k))  # noqa: E731  a chain's name and a half chain's may be equal numbers
        raw = stash(tag(flat, 0).unionByName(tag(alone, 1)))
        points = stash(tag(paths, 0).unionByName(tag(loops, 1)))
        low = points.join(raw.where("cyclic").select("head", "kind", "length"), ["head", "kind"]).groupBy("head", "kind").agg(F.min(F.struct("y", "x", "pos")).alias("low"))
        raw = raw.join(low, ["head", "kind"], "left")
        first = lambda c, other: F.coalesce(F.col(f"low.{other}"), F.col(c)).alias(c)
        direction = F.when(F.col("cyclic"), 0).otherwise(F.col("d0"))
        arcs = raw.select("head", "kind", "image_id", "left", "right", "length", F.col("cyclic").alias("closed"), first("y0", "y"), first("x0", "x"), first("y1", "y"), first("x1", "x"), direction.alias("d0"), F.when(F.col("cyclic"), 3).otherwise(F.col("d1")).alias("d1"), "area2", F.coalesce("low.pos", F.lit(0)).alias("shift"))
        arcs = stash(arcs.withColumn("arc", (F.col("y0") * ROW + F.col("x0")) * 4 + F.col("d0")))
        placed = points.join(arcs.select("head", "kind", "arc", "closed", "length", "shift"), ["head", "kind"])
        placed = placed.withColumn("pos", F.when(F.col("closed"), F.pmod(F.col("pos") - F.col("shift"), F.col("length"))).otherwise(F.col("pos")))
        again = F.when(F.col("closed") & (F.col("pos") == 0), F.array(F.lit(0).cast("long"), F.col("length"))).otherwise(F.array("pos"))
        self.arcs = arcs.drop("head", "kind", "shift")
        self.points = stash(placed.select("image_id", "arc", F.explode(again).alias("pos"), "y", "x"))

    def junctions(self) -> DataFrame:
        """(image_id, y, x, arcs): corners at which three or four arcs end."""
        ends = F.array(*(F.struct(F.col(f"y{k}").alias("y"), F.col(f"x{k}").alias("x")) for k in (0, 1)))
        return self.arcs.where("not closed").select("image_id", F.explode(ends).alias("e")).groupBy("image_id", "e.y", "e.x").agg(F.count("*").alias("arcs"))

    def face_areas(self, points: DataFrame | None = None) -> DataFrame:
        """(image_id, component, area) of each region: the shoelace sums of the arcs around it, of simplified points if given.

        No ring is assembled, so a region of any size is a sum by key.
        """
        if points is None:
            sums = self.arcs
        else:
            along = segments(points).groupBy("image_id", "arc").agg(F.sum(F.col("xa") * F.col("yb") - F.col("xb") * F.col("ya")).alias("area2"))
            sums = self.arcs.drop("area2").join(along, ["image_id", "arc"])
        sided = F.array(F.struct(F.col("right").alias("c"), F.col("area2").alias("s")), F.struct(F.col("left").alias("c"), (-F.col("area2")).alias("s")))
        return sums.select("image_id", F.explode(sided).alias("f")).groupBy("image_id", F.col("f.c").alias("component")).agg((F.sum("f.s") / 2.0).alias("area")).where(F.col("component") != OUTSIDE)

    def rings(self) -> DataFrame:
        """(image_id, component, ring, place, arc, forward): the arcs of each ring around a region, in order, the region to their right.

        At a junction a ring turns right if an arc leaves there, else it goes straight on, else it turns left: so regions
        that touch at a corner alone stay apart. Rings are closed by pointer doubling over arcs; ring is the smallest of its own.
        """
        node = lambda arc, way: F.shiftright(F.xxhash64("image_id", arc), 1) * 2 + way
        both = self.arcs.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"))
        back = F.col("way") == 1
        pick = lambda no, yes: F.when(back, F.col(yes)).otherwise(F.col(no))
        turn = lambda c: (F.col(c) + 2) % 4
        half = both.select(
            "image_id", "arc", "way", "closed", node("arc", F.col("way")).alias("node"), pick("right", "left").alias("component"), "length",
            pick("y0", "y1").alias("ya"), pick("x0", "x1").alias("xa"), pick("y1", "y0").alias("yb"), pick("x1", "x0").alias("xb"),
            F.when(back, turn("d1")).otherwise(F.col("d0")).alias("da"), F.when(back, turn("d0")).otherwise(F.col("d1")).alias("db"))
        half = stash(half.where(F.col("component") != OUTSIDE))
        leaving = half.where("not closed").select("image_id", F.col("ya").alias("yb"), F.col("xa").alias("xb"), F.col("da").alias("out"), F.col("node").alias("next"), F.col("component").alias("c_"))
        ways = F.pmod(F.col("out") - F.col("db") + 1, F.lit(4))  # 2: right, 1: straight, 0: left
        met = half.where("not closed").join(leaving, ["image_id", "yb", "xb"]).where(F.col("c_") == F.col("component")).where(ways < 3)
        after = met.groupBy("node").agg(F.max_by("next", ways).alias("next"))
        open_ = half.where("not closed").select("node", F.lit(1).cast("long").alias("weight")).join(after, "node", "left")
        place = ranked(open_).select("node", F.col("head").alias("ring"), F.col("before").alias("place"))
        out = half.join(place, "node", "left")
        return out.select("image_id", "component", F.coalesce("ring", "node").alias("ring"), F.coalesce("place", F.lit(0)).alias("place"), "arc", (F.col("way") == 0).alias("forward"))

    def polygons(self, points: DataFrame | None = None) -> DataFrame:
        """(image_id, component, ring, hole, points): closed rings of each region, outer ones clockwise (y down); simplified if points are given.

        A row holds a ring, as a polygon's writer needs it; the work before it is by arc.
        """
        lines = (self.points if points is None else points).groupBy("image_id", "arc").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")))).alias("line"))
        xy = F.transform("line", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
        way = F.when(F.col("forward"), xy).otherwise(F.reverse(xy))
        r = self.rings().join(lines, ["image_id", "arc"]).select("image_id", "component", "ring", "place", F.slice(way, 1, F.size("line") - 1).alias("part"))
        r = r.groupBy("image_id", "component", "ring").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda s: s["part"])).alias("p"))
        r = r.withColumn("points", F.concat("p", F.slice("p", 1, 1)))
        pairs = F.zip_with(F.slice("points", 1, F.size("p")), F.slice("points", 2, F.size("p")), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
        return r.select("image_id", "component", "ring", (F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) < 0).alias("hole"), "points")


def segments(points: DataFrame) -> DataFrame:
    """(image_id, arc, pos, ya, xa, yb, xb): the straight pieces of arcs, by the point that they start at."""
    line = points.groupBy("image_id", "arc").agg(F.array_sort(F.collect_list(F.struct("pos", "y", "x"))).alias("p"))
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.struct(a["pos"].alias("pos"), a["y"].alias("ya"), a["x"].alias("xa"), b["y"].alias("yb"), b["x"].alias("xb")))
    return line.where(F.size("p") > 1).select("image_id", "arc", F.explode(pairs).alias("s")).select("image_id", "arc", "s.*")


def _off(y, x, ya, xa, yb, xb):
    """Squared distance of points from a piece of a line, to nine decimals, so that equals are equal; of numpy arrays."""
    dy, dx = yb - ya, xb - xa
    long = dy * dy + dx * dx
    t = np.clip(((y - ya) * dy + (x - xa) * dx) / long, 0, 1) if long else 0.0
    return np.round((y - ya - t * dy) ** 2 + (x - xa - t * dx) ** 2, 9)


def rdp(y: np.ndarray, x: np.ndarray, limit: float) -> np.ndarray:
    """Which points of a line stay: its ends, and of each part the farthest from its chord if that is over the limit (the first of equals)."""
    keep = np.zeros(len(y), bool)
    keep[[0, -1]] = True
    todo = [(0, len(y) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            off = _off(y[a + 1 : b], x[a + 1 : b], y[a], x[a], y[b], x[b])
            m = int(off.argmax())
            if off[m] > limit * limit:
                keep[a + 1 + m] = True
                todo += [(a, a + 1 + m), (a + 1 + m, b)]
    return keep


def by_area(y: np.ndarray, x: np.ndarray, limit: float) -> np.ndarray:
    """Which points of a line stay when the one that spans the smallest triangle with its neighbours goes, again and again, while that is under limit squared.

    Ends stay, and three points of a loop do. Of equal triangles the first point goes first; areas to nine decimals.
    """
    n = len(y)
    keep, before, after = np.ones(n, bool), np.arange(-1, n - 1), np.arange(1, n + 1)
    least = 4 if y[0] == y[-1] and x[0] == x[-1] else 2

    def area(i: int) -> float:
        a, b = before[i], after[i]
        return round(abs((x[i] - x[a]) * (y[b] - y[a]) - (x[b] - x[a]) * (y[i] - y[a])) / 2, 9)

    now = {i: area(i) for i in range(1, n - 1)}
    heap = [(v, i) for i, v in now.items()]
    heapq.heapify(heap)
    left = n
    while heap and left > least:
        v, i = heapq.heappop(heap)
        if now.get(i) != v:
            continue
        if v >= limit * limit:
            break
        keep[i] = False
        left -= 1
        del now[i]
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for j in (a, b):
            if 0 < j < n - 1:
                now[j] = area(j)
                heapq.heappush(heap, (now[j], j))
    return keep


def simplify_by_area(points: DataFrame, tolerance: float | DataFrame, mpp_y: float = 1.0, mpp_x: float = 1.0) -> DataFrame:
    """The points (image_id, arc, pos, y, x) that stay when corners of triangles smaller than tolerance squared go, the smallest first.

    Shared arcs are simplified once, junctions stay; an arc's corners meet in one task, as its row in a file would.
    """
    p = points.join(tolerance, ["image_id", "arc"]) if isinstance(tolerance, DataFrame) else points.withColumn("tolerance", F.lit(float(tolerance)))
    lists = p.groupBy("image_id", "arc").agg(F.array_sort(F.collect_list(F.struct("pos", "y", "x"))).alias("p"), F.first("tolerance").alias("tolerance"))
    return stash(lists.mapInArrow(_fitted(mpp_y, mpp_x, by_area), "image_id string, arc long, pos long, y long, x long"))


def _fitted(my: float, mx: float, rule: Callable[[np.ndarray, np.ndarray, float], np.ndarray] = rdp):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, limit = batch.column(2), batch.column(3).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            pos, y, x = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            keep = np.concatenate([rule(y[a:b] * my, x[a:b] * mx, t) for a, b, t in zip(np.append(0, ends[:-1]), ends, limit, strict=True)]) if len(ends) else np.zeros(0, bool)
            owner = pa.array(np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(pos[keep]), pa.array(y[keep]), pa.array(x[keep])], ["image_id", "arc", "pos", "y", "x"])

    return run


def _farther(my: float, mx: float) -> Column:
    """Squared distance of (y, x) from the chord (ya, xa) to (yb, xb), to nine decimals."""
    dy, dx = (F.col("yb") - F.col("ya")) * my, (F.col("xb") - F.col("xa")) * mx
    py, px = (F.col("y") - F.col("ya")) * my, (F.col("x") - F.col("xa")) * mx
    long = dy * dy + dx * dx
    t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (py * dy + px * dx) / long))).otherwise(F.lit(0.0))
    return F.round(F.pow(py - t * dy, 2) + F.pow(px - t * dx, 2), 9)


def simplify(points: DataFrame, tolerance: float | DataFrame, mpp_y: float = 1.0, mpp_x: float = 1.0, most: int = LONG) -> DataFrame:
    """The points (image_id, arc, pos, y, x) that Ramer, Douglas and Peucker's rule keeps of each arc, by physical distance.

    tolerance: one for all, or a table (image_id, arc, tolerance). Ends stay where they are. A loop is first cut at the
    point farthest from its start, and of one that would keep no area the point farthest from that chord stays as well. Arcs of over
    `most` points are cut by aggregations first, part after part, just where the rule cuts them; a task gets no longer part.
    """
    p = points.join(tolerance, ["image_id", "arc"]) if isinstance(tolerance, DataFrame) else points.withColumn("tolerance", F.lit(float(tolerance)))
    at = F.struct("pos", "y", "x")
    size = p.groupBy("image_id", "arc").agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
    size = size.withColumn("loop", (F.col("a.y") == F.col("b.y")) & (F.col("a.x") == F.col("b.x")))
    part = [F.col(f"{e}.{c}").alias(f"{c}{e}") for e in "ab" for c in ("pos", "y", "x")]
    rows = stash(p.join(size, ["image_id", "arc"]).select("image_id", "arc", "pos", "y", "x", "tolerance", "n", "loop", *part))
    key = ["image_id", "arc", "posa"]
    small, large, first = rows.where(f"not loop and n <= {most}"), rows.where(f"loop or n > {most}"), True
    while not large.isEmpty():
        inner = large.where("pos > posa and pos < posb").withColumn("off", _farther(mpp_y, mpp_x))
        far = inner.groupBy(*key).agg(F.max("off").alias("off"), F.max_by(at, F.struct("off", -F.col("pos"))).alias("m"))
        cut = large.join(far, key).where(F.col("off") > F.when(F.col("loop") & F.lit(first), F.lit(-1.0)).otherwise(F.col("tolerance") * F.col("tolerance")))
        ends = large.join(far, key, "left").where("pos in (posa, posb)").where(F.col("off").isNull() | ~(F.col("off") > F.when(F.col("loop") & F.lit(first), F.lit(-1.0)).otherwise(F.col("tolerance") * F.col("tolerance"))))
        here = F.array(F.struct("posa", "ya", "xa", F.col("m.pos").alias("posb"), F.col("m.y").alias("yb"), F.col("m.x").alias("xb")), F.struct(F.col("m.pos").alias("posa"), F.col("m.y").alias("ya"), F.col("m.x").alias("xa"), "posb", "yb", "xb"))
        parts = cut.select("image_id", "arc", "pos", "y", "x", "tolerance", "loop", F.explode(here).alias("h")).select("image_id", "arc", "pos", "y", "x", "tolerance", "loop", "h.*").where("pos between posa and posb")
        parts = stash(parts.join(parts.groupBy(*key).agg(F.count("*").alias("n")), key))
        small = small.unionByName(ends.select(*small.columns)).unionByName(parts.where(f"n <= {most}").select(*small.columns))
        large, first = parts.where(f"n > {most}").select(*small.columns), False
    lists = small.groupBy(*key).agg(F.first("tolerance").alias("tolerance"), F.array_sort(F.collect_list(at)).alias("p"))
    kept = stash(lists.select("image_id", "arc", "p", "tolerance").mapInArrow(_fitted(mpp_y, mpp_x), "image_id string, arc long, pos long, y long, x long").distinct())
    flat = kept.groupBy("image_id", "arc").agg(F.count("*").alias("n"), F.max_by(F.struct("y", "x"), F.struct("pos")).alias("a"), F.max(F.when(F.col("pos") > 0, F.struct(-F.col("pos"), "y", "x"))).alias("b"))
    flat = flat.where("n = 3").join(rows.where("loop").select("image_id", "arc").distinct(), ["image_id", "arc"]).select("image_id", "arc", F.col("a.y").alias("ya"), F.col("a.x").alias("xa"), F.col("b.y").alias("yb"), F.col("b.x").alias("xb"))
    back = points.join(flat, ["image_id", "arc"]).groupBy("image_id", "arc").agg(F.max_by(at, F.struct(_farther(mpp_y, mpp_x).alias("off"), -F.col("pos"))).alias("m")).select("image_id", "arc", "m.*")
    return kept.unionByName(back)


def _crossing(pdf: pd.DataFrame) -> pd.DataFrame:
    """Arcs of a cell's pieces that cross or touch another piece anywhere but at a common end."""
    pdf = pdf.sort_values(["xl", "arc", "pos"], kind="stable")
    ya, xa, yb, xb = (pdf[c].to_numpy(float) for c in ("ya", "xa", "yb", "xb"))
    low, high = np.minimum(xa, xb), np.maximum(xa, xb)
    upto = np.searchsorted(low, high, "right")
    arc, bad = pdf["arc"].to_numpy(), set()
    side = lambda ay, ax, by, bx, py, px: np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))
    for i in range(len(arc)):
        j = np.arange(i + 1, upto[i])
        j = j[(np.minimum(ya[j], yb[j]) <= max(ya[i], yb[i])) & (np.maximum(ya[j], yb[j]) >= min(ya[i], yb[i]))]
        if not len(j):
            continue
        s1, s2 = side(ya[i], xa[i], yb[i], xb[i], ya[j], xa[j]), side(ya[i], xa[i], yb[i], xb[i], yb[j], xb[j])
        t1, t2 = side(ya[j], xa[j], yb[j], xb[j], ya[i], xa[i]), side(ya[j], xa[j], yb[j], xb[j], yb[i], xb[i])
        same = lambda p, q: (p[0] == q[0]) & (p[1] == q[1])
        ends = [((ya[i], xa[i]), (ya[j], xa[j])), ((ya[i], xa[i]), (yb[j], xb[j])), ((yb[i], xb[i]), (ya[j], xa[j])), ((yb[i], xb[i]), (yb[j], xb[j]))]
        common = sum(same(*e).astype(int) for e in ends)
        meets = (s1 * s2 <= 0) & (t1 * t2 <= 0)
        line = (s1 == 0) & (s2 == 0)
        both = [((yb[i], xb[i]), (yb[j], xb[j]), ends[0]), ((yb[i], xb[i]), (ya[j], xa[j]), ends[1]), ((ya[i], xa[i]), (yb[j], xb[j]), ends[2]), ((ya[i], xa[i]), (ya[j], xa[j]), ends[3])]
        over = np.zeros(len(j), bool)  # on one line from a common end in the same direction
        for p, q, (c, _) in both:
            over |= same(c, _) & line & ((p[0] - c[0]) * (q[0] - c[0]) + (p[1] - c[1]) * (q[1] - c[1]) > 0)
        hit = j[meets & ((common == 0) | over | (common > 1))]
        if len(hit):
            bad.update([arc[i], *arc[hit].tolist()])
    return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "arc": sorted(bad)}) if bad else pd.DataFrame({"image_id": pd.Series([], dtype=object), "arc": pd.Series([], dtype="int64")})


def crossing(points: DataFrame, cell: int = CELL) -> DataFrame:
    """(image_id, arc): arcs that cross or touch one another, or themselves, elsewhere than at a common end.

    Pieces are listed under the index cells of their bounding boxes, cut to the strip that they run through; a cell is swept in a task.
    """
    s = segments(points)
    low, high = lambda c: F.least(f"{c}a", f"{c}b"), lambda c: F.greatest(f"{c}a", f"{c}b")
    s = s.withColumn("cy", F.explode(F.sequence(F.floor(low("y") / cell), F.floor(high("y") / cell))))
    inside = lambda y: F.col("xa") + (F.col("xb") - F.col("xa")) * (F.greatest(low("y"), F.least(high("y"), y)) - F.col("ya")) / (F.col("yb") - F.col("ya"))
    flat = F.col("ya") == F.col("yb")
    one, two = F.when(flat, F.col("xa")).otherwise(inside(F.col("cy") * cell)), F.when(flat, F.col("xb")).otherwise(inside((F.col("cy") + 1) * cell))
    s = s.withColumns({"l_": F.floor(F.least(one, two) / cell - 1e-9), "h_": F.floor(F.greatest(one, two) / cell + 1e-9)}).withColumn("cx", F.explode(F.sequence("l_", "h_")))
    s = s.withColumn("xl", low("x"))
    return s.groupBy("image_id", "cy", "cx").applyInPandas(_crossing, "image_id string, arc long").distinct()


def fitted(coverage: Coverage, tolerance: float | DataFrame, mpp_y: float = 1.0, mpp_x: float = 1.0, rounds: int = 12, most: int = LONG, areas: bool = False) -> DataFrame:
    """The coverage's points, simplified so that no two arcs cross: those that do get half the tolerance, until none does.

    tolerance: one for all, or a table (image_id, arc, tolerance). Neighbours share their arcs, so no gap or overlap opens between them. After the last round arcs that still cross keep
    all their points, as do those that then cross them. areas: by triangles (simplify_by_area) instead of distances.
    """
    limits = stash(tolerance if isinstance(tolerance, DataFrame) else coverage.arcs.select("image_id", "arc", F.lit(float(tolerance)).alias("tolerance")))
    for k in range(rounds + 2):
        out = simplify_by_area(coverage.points, limits, mpp_y, mpp_x) if areas else simplify(coverage.points, limits, mpp_y, mpp_x, most)
        bad = stash(crossing(out))
        if bad.isEmpty():
            break
        less = F.col("tolerance") / 2 if k < rounds else F.lit(0.0)
        limits = stash(limits.join(bad.withColumn("bad", F.lit(True)), ["image_id", "arc"], "left").select("image_id", "arc", F.when(F.col("bad"), less).otherwise(F.col("tolerance")).alias("tolerance")))
    return out


def displacement(exact: DataFrame, points: DataFrame, radius: float, mpp_y: float = 1.0, mpp_x: float = 1.0) -> DataFrame:
    """(image_id, arc, distance) of each arc: how far its exact points lie from the nearest simplified piece of any arc, at most; null if one lies farther than the radius.

    exact, points: (image_id, arc, pos, y, x). Pieces are listed under the index cells, of the radius' size, that they come near to; points
    look at theirs, so only near pairs meet, by equality.
    """
    cell = float(radius)
    s = segments(points).select("image_id", *((F.col(c) * (mpp_y if c[0] == "y" else mpp_x)).alias(c) for c in ("ya", "xa", "yb", "xb")))
    low, high = lambda c: F.least(f"{c}a", f"{c}b"), lambda c: F.greatest(f"{c}a", f"{c}b")
    s = s.withColumn("cy", F.explode(F.sequence(F.floor(low("y") / cell) - 1, F.floor(high("y") / cell) + 1)))
    inside = lambda y: F.col("xa") + (F.col("xb") - F.col("xa")) * (F.greatest(low("y"), F.least(high("y"), y)) - F.col("ya")) / (F.col("yb") - F.col("ya"))
    level = F.col("ya") == F.col("yb")
    one, two = F.when(level, F.col("xa")).otherwise(inside((F.col("cy") - 1) * cell)), F.when(level, F.col("xb")).otherwise(inside((F.col("cy") + 2) * cell))
    s = s.withColumn("cx", F.explode(F.sequence(F.floor(F.least(one, two) / cell) - 1, F.floor(F.greatest(one, two) / cell) + 1)))
    p = exact.select("image_id", "arc", "pos", (F.col("y") * mpp_y).alias("y"), (F.col("x") * mpp_x).alias("x"))
    p = stash(p.withColumns({"cy": F.floor(F.col("y") / cell), "cx": F.floor(F.col("x") / cell)}))
    met = p.join(s, ["image_id", "cy", "cx"]).withColumn("d", F.sqrt(_farther(1.0, 1.0)))
    near = met.where(F.col("d") <= radius + 1e-9).groupBy("image_id", "arc", "pos").agg(F.min("d").alias("d"))
    far = p.join(near, ["image_id", "arc", "pos"], "left").groupBy("image_id", "arc").agg(F.max("d").alias("distance"), F.count_if(F.col("d").isNull()).alias("lost"))
    return far.select("image_id", "arc", F.when(F.col("lost") == 0, F.col("distance")).alias("distance"))
