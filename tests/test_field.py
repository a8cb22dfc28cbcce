"""The distributed solver against a dense solution, and appearance scores against plain arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import field

rng = np.random.default_rng(3)


def dense(h, w, guide, spacing, length, diagonal, rhs, there=None):
    """The whole matrix."""
    n, at = h * w, np.arange(h * w).reshape(h, w)
    there = np.ones((h, w), bool) if there is None else there
    a = np.diag(diagonal.ravel().astype(float))
    for i, j, s in ((at[:-1], at[1:], spacing[0]), (at[:, :-1], at[:, 1:], spacing[1])):
        for p, q in zip(i.ravel(), j.ravel()):
            if there.ravel()[p] and there.ravel()[q]:
                t = (length / s) ** 2 * (0.02 + np.exp(-((guide.reshape(n, -1)[p] - guide.reshape(n, -1)[q]) ** 2).sum() / (2 * 0.1**2)))
                a[p, p] += t
                a[q, q] += t
                a[p, q] -= t
                a[q, p] -= t
    return np.linalg.solve(a, rhs.reshape(n, -1)).reshape(h, w, -1)


def systems(spark, parts):
    """Systems by name: (h, w, guide, diagonal, rhs, there)."""
    guides, rows = [], []
    for name, (h, w, guide, diagonal, rhs, there) in parts.items():
        for y in range(h):
            for x in range(w):
                if there[y, x]:
                    guides.append((name, y, x, guide[y, x].tolist()))
                    rows.append((name, y, x, float(diagonal[y, x]), rhs[y, x].tolist()))
    g = spark.createDataFrame(guides, "image_id string, y long, x long, g array<double>")
    ties = field.conductances(g, "g", (2.0, 3.0), 6.0, block=5).withColumnRenamed("image_id", "system")
    return ties.join(spark.createDataFrame(rows, "system string, y long, x long, diagonal double, rhs array<double>"), ["system", "y", "x"])


def make(h, w, k, holes=0.0):
    return h, w, rng.random((h, w, 3)) * 0.4, np.where(rng.random((h, w)) < 0.4, rng.random((h, w)) * 5, 0) + 0.015, rng.normal(size=(h, w, k)), rng.random((h, w)) >= holes


@pytest.mark.parametrize("block", [64, 6])
def test_equals_the_dense_solution(spark, block):
    parts = {"a": make(13, 17, 2), "b": make(9, 4, 2, 0.2)}
    df = systems(spark, parts)
    got = {(r.system, r.y, r.x): r.u for r in field.solve(df, block).collect()}
    assert len(got) == df.count()
    for name, (h, w, guide, diagonal, rhs, there) in parts.items():
        want = dense(h, w, guide, (2.0, 3.0), 6.0, diagonal, rhs, there)
        assert all(np.allclose(got[name, y, x], want[y, x], rtol=1e-6, atol=1e-6) for y in range(h) for x in range(w) if there[y, x])


def test_nothing_and_no_end(spark):
    df = systems(spark, {"a": make(8, 8, 1)})
    assert field.solve(df.limit(0)).collect() == []
    with pytest.raises(RuntimeError, match="settle"):
        field.solve(df, 3, 1e-12, 2)


def test_appearance_tells_classes_whose_colour_drifts(spark):
    """Two classes whose colours both drift across the image: fixed means would fail, fields follow."""
    h, w = 24, 32
    truth = 1 + ((np.indices((h, w))[0] // 6 + np.indices((h, w))[1] // 8) % 2)
    drift = np.indices((h, w))[1] / w * 1.2
    v = np.stack([drift + 0.5 * (truth == 2), 1 - drift + 0.3 * (truth == 1), 0.2 * drift], axis=2) + 0.03 * rng.normal(size=(h, w, 3))
    known = rng.random((h, w)) < 0.5
    rows = [("a", y, x, v[y, x].tolist(), 1.0, int(truth[y, x]) if known[y, x] else 0, 200, 180, 190) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "image_id string, y long, x long, v array<double>, weight double, label long, r int, g int, b int")
    out = field.appearance(df, (h, w), (1.0, 1.0), field_um=4.0, length_um=8.0, block=5).collect()
    assert len(out) == h * w and all(0.5 <= r.p <= 1 for r in out)
    assert np.mean([r.label == truth[r.y, r.x] for r in out]) > 0.95
    stats = field.class_colours(df).first()
    precision, score = np.reshape(stats.precision, (3, 3)), []
    corner = np.clip(((np.arange(h) + 0.5) / 4 - 0.5)[:, None], 0, h // 4 - 1), np.clip(((np.arange(w) + 0.5) / 4 - 0.5)[None], 0, w // 4 - 1)
    for k, mean in zip(stats.labels, stats.means):
        m = ((truth == k) & known).astype(float)
        mass = m.reshape(h // 4, 4, w // 4, 4).mean(axis=(1, 3)) + field.PRIOR
        sums = (m[..., None] * v).reshape(h // 4, 4, w // 4, 4, 3).mean(axis=(1, 3)) + field.PRIOR * np.array(mean)
        u = dense(h // 4, w // 4, np.zeros((h // 4, w // 4, 3)), (4.0, 4.0), 8.0, mass, sums)
        y0, x0 = np.minimum(corner[0].astype(int), h // 4 - 2), np.minimum(corner[1].astype(int), w // 4 - 2)
        fy, fx = (corner[0] - y0)[..., None], (corner[1] - x0)[..., None]
        up = (1 - fy) * (1 - fx) * u[y0, x0] + (1 - fy) * fx * u[y0, x0 + 1] + fy * (1 - fx) * u[y0 + 1, x0] + fy * fx * u[y0 + 1, x0 + 1]
        score.append(-0.5 * np.einsum("yxi,ij,yxj->yx", v - up, precision, v - up))
    p = np.exp(np.stack(score) - np.max(score, axis=0))
    p /= p.sum(axis=0)
    assert all(r.label == 1 + p[:, r.y, r.x].argmax() and abs(r.p - p[:, r.y, r.x].max()) < 1e-5 for r in out)


def test_class_colours_are_those_of_the_rows(spark):
    x, label, weight = rng.normal(size=(60, 3)), rng.integers(1, 4, 60), rng.random(60) + 0.1
    df = spark.createDataFrame([("a", int(t), float(u), q.tolist()) for q, t, u in zip(x, label, weight)], "image_id string, label long, weight double, v array<double>")
    r = field.class_colours(df).first()
    means = np.stack([np.average(x[label == c], axis=0, weights=weight[label == c]) for c in (1, 2, 3)])
    assert r.labels == [1, 2, 3] and np.allclose(r.means, means)
    scale = np.maximum(x.std(axis=0), 0.05)
    d = (x - means[label - 1]) / scale
    c = (d.T * weight) @ d / weight.sum()
    c = 0.8 * c + 0.2 * np.diag(np.diag(c)) + 0.0025 * np.eye(3)
    assert np.allclose(np.reshape(r.precision, (3, 3)), np.linalg.inv(c * np.outer(scale, scale)))
