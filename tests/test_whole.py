"""Queries over whole tables against numpy, and that they leave no row out."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from tests.conftest import SF

from tessella.operators import grid
from tessella.plans import queries_whole  # noqa: F401
from tessella.plans.registry import QUERIES


@pytest.fixture(scope="module")
def raster():
    e = pq.read_table(f"{SF}/events.parquet").sort_by("event_id").to_pydict()
    n = len(e["event_id"])
    w = 400 if n >= 100_000 else 100 if n >= 10_000 else 40
    assert n % w == 0 and e["event_id"] == list(range(n))
    y, x = np.divmod(np.arange(n), w)
    truth = 1 + (y // 8 + x // 8) % 4
    value = np.array(e["value"], float)
    pred = np.where(value > 150, 1 + truth % 4, truth)
    return {"truth": truth.reshape(-1, w), "pred": pred.reshape(-1, w), "value": value.reshape(-1, w), "kind": np.array(e["event_type"]).reshape(-1, w)}


@pytest.fixture(scope="module")
def tokens():
    t = pq.read_table(f"{SF}/embeddings.parquet").sort_by("vec_id").to_pydict()
    return {divmod(i, 20): float(e[0]) for i, e in zip(t["vec_id"], t["embedding"], strict=True)}


def got(spark, name):
    rows = [tuple(r) for r in QUERIES[f"op_{name}_whole"](spark, SF).collect()]
    out = {r[:-1]: r[-1] for r in rows}
    assert len(out) == len(rows)
    return out


def cells(a):
    return {(y, x): a[y, x] for y in range(a.shape[0]) for x in range(a.shape[1])}


def close(a, b, by=1e-5):
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= by for k in a)


def linear(a, ys, xs):
    h, w = a.shape
    y, x = np.clip((ys + 0.5) / 2 - 0.5, 0, h - 1), np.clip((xs + 0.5) / 2 - 0.5, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), y - y0, x - x0
    return (1 - fy) * ((1 - fx) * a[y0, x0] + fx * a[y0, x1]) + fy * ((1 - fx) * a[y1, x0] + fx * a[y1, x1])


def test_nearest_and_bilinear(spark, raster):
    p = raster["pred"]
    h, w = p.shape
    ys, xs = (np.floor((np.arange((n + 1) // 2) + 0.5) * n / ((n + 1) // 2)).astype(int) for n in (h, w))
    assert got(spark, "R03_nearest") == cells(p[np.ix_(ys, xs)])
    y, x = np.mgrid[: 2 * h, : 2 * w]
    close(got(spark, "R04_bilinear"), cells(linear(raster["value"], y, x)))


def test_areas(spark, raster):
    fine, kind = (raster[k].repeat(3, 0).repeat(3, 1) for k in ("value", "kind"))
    mean, area = {}, {}
    for y in range(0, fine.shape[0], 8):
        for x in range(0, fine.shape[1], 8):
            mean[y // 8, x // 8] = fine[y : y + 8, x : x + 8].mean()
            area |= {(y // 8, x // 8, k): n for k, n in zip(*np.unique(kind[y : y + 8, x : x + 8], return_counts=True), strict=True)}
    close(got(spark, "R05_area"), mean)
    assert got(spark, "A16_tile_qc_area") == area


def test_smoothing(spark, raster):
    p, k = raster["pred"], np.array(grid.gaussian_weights(1.5))
    r = len(k) // 2
    scores = []
    for c in (1, 2, 3, 4):
        q = np.pad((p == c).astype(float), r, mode="reflect")
        q = sum(w * q[i : i + p.shape[0]] for i, w in enumerate(k))
        scores.append(np.round(sum(w * q[:, i : i + p.shape[1]] for i, w in enumerate(k)), 9))
    assert got(spark, "R08_contour_smoothing") == cells(1 + np.argmax(scores, axis=0))


def test_distances(spark, raster):
    t = raster["truth"]
    edge = np.zeros(t.shape, bool)
    down, right = t[1:] != t[:-1], t[:, 1:] != t[:, :-1]
    edge[1:] |= down
    edge[:-1] |= down
    edge[:, 1:] |= right
    edge[:, :-1] |= right
    by, bx = np.nonzero(edge)
    want = {(y, x): np.sqrt((2.0 * (by - y)) ** 2 + (bx - x) ** 2).min() for y, x in np.ndindex(t.shape)}
    close(got(spark, "R16_distance"), want)


def test_tokens(spark, tokens):
    top, low = {}, {}
    for wy, wx in tokens:
        for i, j in np.ndindex(8, 8):
            k = max(np.sin(np.pi * (i + 0.5) / 8) ** 2, 0.05) * max(np.sin(np.pi * (j + 0.5) / 8) ** 2, 0.05)
            at = (wy * 4 + i, wx * 4 + j)
            top[at] = top.get(at, 0) + k * ((wy * 7 + wx * 3 + i + j) % 11)
            low[at] = low.get(at, 0) + k
    close(got(spark, "M21_hann_blend"), {k: top[k] / low[k] for k in top})
    h = max(y for y, _ in tokens) + 1
    half = np.array([[np.mean([tokens[2 * y + i, 2 * x + j] for i, j in np.ndindex(2, 2)]) for x in range(10)] for y in range(h // 2)])
    ys, xs = np.array(sorted(tokens)).T
    close(got(spark, "J05_scale_alignment"), dict(zip(zip(ys.tolist(), xs.tolist(), strict=True), linear(half, ys, xs), strict=True)))


def test_component_order_has_all(spark, raster):
    p = raster["pred"]
    left, want = set(np.ndindex(p.shape)), {}
    while left:
        todo, part = [left.pop()], []
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            near = {(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)} & left
            near = {q for q in near if p[q] == p[y, x]}
            left -= near
            todo += near
        ys, xs = zip(*part, strict=True)
        want.setdefault(int(p[part[0]]), []).append((-len(part), min(xs), min(ys), max(xs), max(ys)))
    rows = sorted(tuple(r) for r in QUERIES["op_K08_component_order_whole"](spark, SF).collect())
    assert rows == [(c, i + 1, -o[0], *o[1:]) for c in sorted(want) for i, o in enumerate(sorted(want[c]))]
