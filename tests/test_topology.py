"""Shared arcs, their simplification, faces and crossings, against plain walks of small rasters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import components, graph, topology, vector

rng = np.random.default_rng(11)


def cells(spark, a, image="a"):
    return spark.createDataFrame([(image, y, x, int(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "image_id string, y long, x long, label long")


def covered(spark, a, block, **k):
    labelled = components.label_components(cells(spark, a), "label", block=block)
    return labelled, topology.Coverage(labelled, block=block, **k)


def plain_junctions(a):
    p = np.pad(a, 1)
    out = {}
    for y in range(a.shape[0] + 1):
        for x in range(a.shape[1] + 1):
            q = p[y, x], p[y, x + 1], p[y + 1, x + 1], p[y + 1, x]
            n = sum(q[i] != q[i - 1] for i in range(4))
            if n > 2:
                out[y, x] = n
    return out


def lines(coverage):
    out = {}
    for r in coverage.points.orderBy("arc", "pos").collect():
        out.setdefault(r.arc, []).append((r.pos, r.y, r.x))
    return out


@pytest.mark.parametrize("kind", ["noise", "checker", "ring"])
def test_arcs_of_blocks_of_any_size(spark, kind, monkeypatch):
    a = {
        "noise": rng.integers(0, 3, (13, 11)),
        "checker": np.indices((6, 6)).sum(axis=0) % 2 + 1, "ring": np.pad(np.pad(np.full((6, 6), 2), 3, constant_values=1), 2),
    }[kind]
    labelled, whole = covered(spark, a, 64)
    if kind == "ring":  # loops over many blocks, and the distributed forms of the closure and the ranks
        monkeypatch.setattr(graph.components, "__defaults__", (60, 0))
        monkeypatch.setattr(graph.ranked, "__defaults__", (60, 0))
    _, cut = covered(spark, a, 4)
    columns = ["arc", "left", "right", "length", "closed", "y0", "x0", "y1", "x1", "d0", "d1", "area2"]
    assert sorted(map(tuple, whole.arcs.select(*columns).collect())) == sorted(map(tuple, cut.arcs.select(*columns).collect()))
    assert lines(whole) == lines(cut)
    assert {(r.y, r.x): r.arcs for r in cut.junctions().collect()} == plain_junctions(a)
    edges = topology.region_edges(labelled).count()
    assert sum(r.length for r in cut.arcs.collect()) == edges
    for r in cut.arcs.collect():
        p = lines(cut)[r.arc]
        assert p[0] == (0, r.y0, r.x0) and p[-1] == (r.length, r.y1, r.x1)
        assert all(abs(b[1] - c[1]) + abs(b[2] - c[2]) == c[0] - b[0] and (b[1] == c[1]) != (b[2] == c[2]) for b, c in zip(p, p[1:]))
    areas = {r.component: r.area for r in cut.face_areas().collect()}
    assert areas == {r.component: float(r["count"]) for r in labelled.groupBy("component").count().collect()}


def test_polygons_are_those_of_the_plain_walk(spark):
    a = rng.integers(0, 3, (12, 10))
    labelled, c = covered(spark, a, 5)

    def canonical(points):
        p = [(q.x, q.y) for q in points][:-1]
        p = [q for i, q in enumerate(p) if (q[0] - p[i - 1][0]) * (p[(i + 1) % len(p)][1] - q[1]) != (q[1] - p[i - 1][1]) * (p[(i + 1) % len(p)][0] - q[0])]
        k = p.index(min(p))
        return tuple(p[k:] + p[:k])

    want = sorted((r.component, r.hole, canonical(r.points)) for r in vector.polygonize(labelled).collect())
    assert want == sorted((r.component, r.hole, canonical(r.points)) for r in c.polygons().collect())


def test_neighbours_share_their_arcs(spark):
    """A staircase between two regions becomes one straight line that both have; the frame keeps its corners."""
    y, x = np.mgrid[:60, :70]
    labelled, c = covered(spark, np.where(x > y + 5, 1, 2), 16)
    before, points = c.points.count(), topology.fitted(c, 1.0)
    assert points.count() < before / 10
    assert points.join(c.arcs.where(f"left <> {topology.OUTSIDE} and right <> {topology.OUTSIDE}").select("arc"), "arc").count() == 2
    areas = {r.component: r.area for r in c.face_areas(points).collect()}
    sizes = {r.component: r["count"] for r in labelled.groupBy("component").count().collect()}
    assert math.isclose(sum(areas.values()), sum(sizes.values())) and all(abs(areas[k] - sizes[k]) < 0.03 * sizes[k] for k in sizes)
    polygons = c.polygons(points)
    sides = polygons.select("component", F.explode(F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("s")).select("component", "s.*")
    back = sides.select(F.col("component").alias("c_"), F.col("p").alias("q"), F.col("q").alias("p"))
    assert sides.join(back, ["p", "q"]).where("component < c_").count() == 1


def plain_rdp(p, limit, my, mx, closed):
    def off(q, a, b):
        (qy, qx), (ay, ax), (by, bx) = ((v[1] * my, v[2] * mx) for v in (q, a, b))
        dy, dx = by - ay, bx - ax
        n = dy * dy + dx * dx
        t = max(0, min(1, ((qy - ay) * dy + (qx - ax) * dx) / n)) if n else 0
        return round((qy - ay - t * dy) ** 2 + (qx - ax - t * dx) ** 2, 9)

    def cut(a, b, force=False):
        inner = p[a + 1 : b]
        if not inner:
            return [a]
        d = [off(q, p[a], p[b]) for q in inner]
        m = a + 1 + d.index(max(d))
        return cut(a, m) + cut(m, b) if force or max(d) > limit**2 else [a]

    kept = [p[i] for i in cut(0, len(p) - 1, closed)] + [p[-1]]
    if closed and len(kept) == 3:
        d = [off(q, kept[0], kept[1]) for q in p]
        kept = sorted([*kept, p[d.index(max(d))]])
    return kept


@pytest.mark.parametrize("most", [50_000, 5])
def test_simplified_lines_are_those_of_the_recursion(spark, most):
    """Whole in a task, or cut by aggregations first: the same points."""
    a = np.kron(rng.integers(0, 3, (6, 6)), np.ones((4, 3), int))
    a ^= rng.random(a.shape) < 0.08
    _, c = covered(spark, a, 8)
    closed = {r.arc: r.closed or (r.y0, r.x0) == (r.y1, r.x1) for r in c.arcs.collect()}
    got = {}
    for r in topology.simplify(c.points, 1.3, 0.5, 2.0, most).orderBy("arc", "pos").collect():
        got.setdefault(r.arc, []).append((r.pos, r.y, r.x))
    assert got == {k: plain_rdp(p, 1.3, 0.5, 2.0, closed[k]) for k, p in lines(c).items()}


def test_crossing_lines_are_found(spark):
    rows = [(1, [(0, 0), (10, 10)]), (2, [(0, 10), (10, 0)]), (3, [(0, 0), (0, 10)]), (4, [(20, 0), (200, 300)]), (5, [(199, 300), (20, 3)]), (6, [(5, 100), (300, 100)]), (7, [(400, 0), (400, 50)]), (8, [(400, 20), (400, 90)]), (9, [(500, 0), (500, 50)]), (10, [(500, 50), (500, 90)]), (11, [(500, 50), (500, 10)])]
    points = spark.createDataFrame([("a", arc, k, y, x) for arc, p in rows for k, (y, x) in enumerate(p)], "image_id string, arc long, pos long, y long, x long")
    for cell in (8, 64, 1000):
        assert {r.arc for r in topology.crossing(points, cell).collect()} == {1, 2, 4, 5, 6, 7, 8, 9, 11}


def test_fitted_lines_never_cross(spark):
    a = rng.integers(0, 4, (30, 30))
    labelled, c = covered(spark, np.kron(a, np.ones((2, 2), int)), 16)
    points = topology.fitted(c, 6.0)
    assert topology.crossing(points).isEmpty() and points.count() < c.points.count()
    areas = [r.area for r in c.face_areas(points).collect()]
    assert min(areas) > 0 and len(areas) == labelled.select("component").distinct().count()


def test_two_images_and_nothing(spark):
    a = cells(spark, np.ones((3, 3), int), "a").unionByName(cells(spark, np.ones((5, 2), int), "b"))
    c = topology.Coverage(components.label_components(a, "label"), 4)
    assert sorted((r.image_id, r.area) for r in c.face_areas().collect()) == [("a", 9.0), ("b", 10.0)]
    none = topology.Coverage(components.label_components(a.limit(0), "label"))
    assert none.arcs.count() == none.polygons().count() == topology.fitted(none, 1.0).count() == 0


@pytest.mark.parametrize("small", [20_000, 0])
def test_places_along_paths(spark, small):
    big = (1 << 62) + 1
    nxt = {1: 2, 2: 3, 3: None, 10: 11, 11: 12, 12: 10, 20: None, 30: 30, **{100 + i: 101 + i for i in range(70)}, 170: None, big: big + 2, big + 2: None}
    rows = graph.ranked(spark.createDataFrame([(k, v, k % 3 + 1) for k, v in nxt.items()], "node long, next long, weight long"), small=small).collect()
    got = {r.node: (r.head, r.before, r.total, r.cyclic) for r in rows}
    w = lambda *n: sum(k % 3 + 1 for k in n)
    assert got[3] == (1, w(1, 2), w(1, 2, 3), False) and got[20] == (20, 0, w(20), False) and got[30] == (30, 0, w(30), True)
    assert got[12] == (10, w(10, 11), w(10, 11, 12), True) and got[170] == (100, w(*range(100, 170)), w(*range(100, 171)), False)
    assert len(rows) == len(nxt) and got[big + 2] == (big, w(big), w(big, big + 2), False)


def test_points_go_by_their_triangles(spark):
    a = np.kron(rng.integers(0, 3, (5, 5)), np.ones((4, 3), int))
    _, c = covered(spark, a, 8)

    def plain(p, limit):
        p, least = list(p), 4 if p[0][1:] == p[-1][1:] else 2
        while len(p) > least:
            size = [abs((q[2] - u[2]) * (v[1] - u[1]) - (v[2] - u[2]) * (q[1] - u[1])) / 2 for u, q, v in zip(p, p[1:], p[2:])]
            if min(size) >= limit**2:
                break
            del p[1 + size.index(min(size))]
        return p

    got = {}
    for r in topology.simplify_by_area(c.points, 1.6).orderBy("arc", "pos").collect():
        got.setdefault(r.arc, []).append((r.pos, r.y, r.x))
    assert got == {k: plain(p, 1.6) for k, p in lines(c).items()}
    assert topology.crossing(topology.fitted(c, 3.0, areas=True)).isEmpty()


def test_displacement_of_arcs(spark):
    _, c = covered(spark, np.where(np.add.outer(np.arange(20), np.arange(24)) % 40 > 19, 1, 2), 16)
    points = topology.simplify(c.points, 3.0)
    kept = {}
    for r in points.orderBy("arc", "pos").collect():
        kept.setdefault(r.arc, []).append((r.y, r.x))
    pieces = [(p, q) for v in kept.values() for p, q in zip(v, v[1:])]

    def off(y, x):
        best = math.inf
        for (ay, ax), (by, bx) in pieces:
            dy, dx = by - ay, bx - ax
            t = max(0, min(1, ((y - ay) * dy + (x - ax) * dx) / (dy * dy + dx * dx)))
            best = min(best, math.hypot(y - ay - t * dy, x - ax - t * dx))
        return best

    want = {k: max(off(y, x) for _, y, x in v) for k, v in lines(c).items()}
    got = {r.arc: r.distance for r in topology.displacement(c.points, points, 3.0).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert max(want.values()) > 0.5
    small = {r.arc: r.distance for r in topology.displacement(c.points, points, 0.5).collect()}
    assert all((small[k] is None) == (want[k] > 0.5) for k in want)
