"""Diffusion and smoothing by blocks with a halo."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import grid, stencil

rng = np.random.default_rng(2)


def frame(spark, p, he, inside, image="a"):
    h, w = inside.shape
    rows = [(image, y, x, p[y, x].tolist(), *map(int, he[y, x]), bool(inside[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id string, y long, x long, p array<double>, r int, g int, b int, inside boolean")


def plain(p, he, inside, rounds=16):
    """Cell by cell."""
    h, w = inside.shape
    taps = np.exp(-0.5 * np.arange(-3, 4) ** 2.0)
    taps /= taps.sum()
    mirror = lambda i, n: 0 if n == 1 else (n - 1) - abs((n - 1) - i % (2 * n - 2))
    rows = np.array([[sum(t * he[mirror(y + k - 3, h), x].astype(float) for k, t in enumerate(taps)) for x in range(w)] for y in range(h)])
    od = -np.log((np.rint(np.array([[sum(t * rows[y, mirror(x + k - 3, w)] for k, t in enumerate(taps)) for x in range(w)] for y in range(h)])) + 1) / 256)
    p = np.where(inside[..., None], p, 0)
    p = p / np.maximum(p.sum(axis=2, keepdims=True), 1e-6)
    q = p
    for _ in range(rounds):
        new = p.copy()
        for y in range(h):
            for x in range(w):
                total = 1.0
                for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= v < h and 0 <= u < w and inside[y, x] and inside[v, u]:
                        c = 3 * (0.02 + 0.98 * np.exp(-((od[y, x] - od[v, u]) ** 2).sum() / (2 * 0.18**2)))
                        total += c
                        new[y, x] = new[y, x] + c * q[v, u]
                new[y, x] = new[y, x] / total
        q = new
    return q


def case(h, w, k=3):
    p = rng.random((h, w, k)) ** 3
    he = np.clip(200 - 90 * ((np.indices((h, w)).sum(axis=0) // 5) % 2)[..., None] + rng.integers(-8, 9, (h, w, 3)), 0, 255)
    return p, he, rng.random((h, w)) > 0.15


def test_steps_are_those_cell_by_cell():
    p, he, inside = case(9, 12)
    assert np.allclose(stencil.diffused(p, he, inside), plain(p, he, inside), atol=1e-12)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_blocks_change_nothing(spark, spread):
    p, he, inside = case(40, 50)
    df = frame(spark, p, he, inside).unionByName(frame(spark, *case(7, 3), image="b"))
    one = {tuple(r) for r in stencil.diffuse(df, 64, spread).collect()}
    assert one == {tuple(r) for r in stencil.diffuse(df, 13, spread).collect()} and len(one) == 2021
    if not spread:
        want = np.where(inside, plain(p, he, inside).argmax(axis=2) + 1, 0)
        assert all(want[y, x] == v for i, y, x, v in one if i == "a")


def test_one_exchange(spark):
    df = frame(spark, *case(5, 5))
    plan = stencil.diffuse(df, 64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_smoothing_is_that_of_the_taps(spark):
    a = rng.integers(0, 4, (20, 24))
    a[4:9, 4:9] = 0
    df = spark.createDataFrame([("a", y, x, int(a[y, x])) for y in range(20) for x in range(24)], "image_id string, y long, x long, label long")
    want = grid.smoothed_labels(df, "label", (1.5, 0.8), 20, 24, (0, 1, 2, 3), "mirror", fixed_zero=True)
    for block in (7, 64):
        assert sorted(map(tuple, stencil.smoothed(df, (1.5, 0.8), block).collect())) == sorted(map(tuple, want.collect()))


def test_guided_labels_follow_the_stain(spark):
    """Two tissues of different stain; coarse probabilities know them only roughly."""
    h, w = 56, 84
    dark = np.indices((h, w))[1] + 4 * np.sin(np.indices((h, w))[0] / 5) > 40
    rows = [("a", y, x, *([90, 60, 120] if dark[y, x] else [220, 180, 200]), not (y < 6 and x < 6)) for y in range(h) for x in range(w)]
    native = spark.createDataFrame(rows, "image_id string, y long, x long, r int, g int, b int, support boolean")
    tok = [("a", y, x, [0.2, 0.8] if 14 * x + 7 > 40 else [0.8, 0.2]) for y in range(4) for x in range(6)]
    p = spark.createDataFrame(tok, "image_id string, y long, x long, p array<double>")
    out = {(r.y, r.x): r.label for r in stencil.guided_labels(p, (4, 6), native, (h, w), (0.5, 0.5), block=32).collect()}
    assert len(out) == h * w and all((out[y, x] == 0) == (y < 6 and x < 6) for y, x in out)
    right = [out[y, x] == 1 + int(dark[y, x]) for y, x in out if out[y, x]]
    assert np.mean(right) > 0.95
    other = {(r.y, r.x): r.label for r in stencil.guided_labels(p, (4, 6), native, (h, w), (0.5, 0.5), block=17).collect()}
    assert out == other


def test_only_unsure_cells_at_borders_move(spark):
    h, w = 30, 34
    dark = np.indices((h, w))[1] + 3 * np.sin(np.indices((h, w))[0] / 4) > 16
    p = np.where((np.indices((h, w))[1] > 14)[..., None], [0.45, 0.55], [0.55, 0.45]) + 0.0
    p = np.where((rng.random((h, w)) < 0.1)[..., None], p[..., ::-1], p)
    p[:, :4], p[:, -4:] = [0.95, 0.05], [0.05, 0.95]
    he = np.where(dark[..., None], 80, 210) + rng.integers(-3, 4, (h, w, 3))
    inside = rng.random((h, w)) > 0.05
    df = frame(spark, p, he, inside).withColumnRenamed("inside", "support")
    arguments = dict(mpp=(0.5, 0.5), smoothness=2.0, rounds=6, sigma=0.3, margin=0.2, distance_um=2.0, blur_um=0.4)
    got = {(r.y, r.x): r for r in stencil.refine_boundaries(df, block=64, **arguments).collect()}
    assert got == {(r.y, r.x): r for r in stencil.refine_boundaries(df, block=7, **arguments).collect()}
    raw = np.where(inside, p.argmax(axis=2) + 1, 0)
    edge = [(y, x) for y in range(h) for x in range(w) if raw[y, x] and any(0 <= v < h and 0 <= u < w and raw[v, u] not in (0, raw[y, x]) for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)))]
    movable = np.array([[bool(raw[y, x]) and abs(p[y, x, 0] - p[y, x, 1]) <= 0.2 and min(np.hypot(y - v, x - u) for v, u in edge) * 0.5 <= 2.0 for x in range(w)] for y in range(h)])
    q = stencil.refined(p, he, inside, movable, (0.5, 0.5), 2.0, 6, 0.4, 0.3)
    assert [(k, r.raw, r.movable) for k, r in sorted(got.items()) if (r.raw, r.movable) != (raw[k], movable[k])] == []
    for (y, x), r in got.items():
        assert r.label == (q[y, x].argmax() + 1 if movable[y, x] else raw[y, x])
    assert sum(r.label != r.raw for r in got.values()) > 5
    with pytest.raises(ValueError, match="vanish"):
        few = np.where(np.indices((h, w))[1][..., None] == 20, [0.49, 0.51], [0.51, 0.49]) + 0.0
        stencil.refine_boundaries(frame(spark, few, np.full((h, w, 3), 90), np.ones((h, w), bool)).withColumnRenamed("inside", "support"), **arguments)


@pytest.mark.parametrize("edge", ["nearest", "reflect"])
def test_offset_means_leave_out_what_a_join_would(spark, edge):
    """A last row that ends early, an island, a null and a NaN: neighbours as the SQL of J03 and J04 joins them."""
    h, w, nan = 9, 5, float("nan")
    here = {(y, x): float(y * w + x) ** 2 for y in range(h) for x in range(w) if y < h - 3 or (y == h - 2 and x == 2) or (y == h - 1 and x < 2)}
    here[1, 1], here[4, 3] = None, nan
    clamp = {"nearest": lambda v, n: max(0, min(v, n - 1)), "reflect": lambda v, n: v % (2 * n) if v % (2 * n) < n else 2 * n - 1 - v % (2 * n)}[edge]
    want = {}
    for y, x in here:
        met = [here[q] for d in (1, 2, 4) for dy, dx in ((-d, 0), (d, 0), (0, -d), (0, d)) if (q := (clamp(y + dy, h), clamp(x + dx, w))) in here]
        held = [v for v in met if v is not None]
        if met:
            want[y, x] = sum(held) / len(held) if held else None
    df = spark.createDataFrame([("a", y, x, v) for (y, x), v in here.items()], "image_id string, y long, x long, v double")
    for block in (3, 256):
        got = {(r.y, r.x): r["mean"] for r in grid.offset_means(df, "v", h, w, edge=edge, block=block, absent="out").collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want)
    own = {(r.y, r.x): r["mean"] for r in grid.offset_means(df, "v", h, w, edge=edge).collect()}
    assert own.keys() == here.keys() and own[4, 2] is not None and own[4, 3] is None
