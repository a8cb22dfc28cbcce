"""SIMPLS from cross-products against SIMPLS on the rows, and the discriminant on its scores."""

import numpy as np
import pytest

from tessella.operators import features, pls


def on_rows(x, labels, k):
    """The same components from the rows themselves: weights for autoscaled columns."""
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    classes = np.unique(labels)
    y = (labels[:, None] == classes).astype(float)
    y -= y.mean(axis=0)
    s, loadings, weights = z.T @ y, [], []
    for _ in range(k):
        r = np.linalg.svd(s, full_matrices=False)[0][:, 0]
        t = z @ r
        r, t = r / np.linalg.norm(t), t / np.linalg.norm(t)
        v = z.T @ t
        for w in loadings:
            v -= w * (w @ v)
        v /= np.linalg.norm(v)
        s = s - np.outer(v, v @ s)
        loadings.append(v)
        weights.append(r)
    return z, np.stack(weights, axis=1)


def by_scores(t, labels):
    """Linear discriminant of rows of scores, shares as priors."""
    classes = np.unique(labels)
    means = np.stack([t[labels == c].mean(axis=0) for c in classes])
    left = np.concatenate([t[labels == c] - t[labels == c].mean(axis=0) for c in classes])
    inverse = np.linalg.inv(left.T @ left / (len(t) - len(classes)))
    return np.stack([t @ inverse @ m - 0.5 * m @ inverse @ m + np.log((labels == c).mean()) for c, m in zip(classes, means)], axis=1)


def grams(x, labels):
    one = np.column_stack((x, np.ones(len(x))))
    return {int(c): one[labels == c].T @ one[labels == c] for c in np.unique(labels)}


@pytest.mark.parametrize("n,p,k,classes", [(90, 12, 3, 4), (60, 30, 8, 3), (40, 200, 6, 2)])
def test_components_are_those_of_the_rows(n, p, k, classes):
    rng = np.random.default_rng(p)
    labels = np.arange(n) % classes + 1
    x = rng.normal(size=(n, p)) * rng.uniform(0.1, 9, p) + 5 + (labels[:, None] == np.arange(p) % 7)
    z, want = on_rows(x, labels, k)
    got = pls.simpls(grams(x, labels), k)
    assert np.allclose((z @ want).T @ (z @ want), np.eye(k), atol=1e-8)
    agree = np.abs(np.sum((z @ want) * (z @ got.weights), axis=0))
    assert got.weights.shape == (p, k) and np.allclose(agree, 1, atol=1e-6)
    head = pls.discriminant(grams(x, labels), got)
    scores = x @ head.coef + head.intercept
    plain = by_scores(z @ want, labels)
    assert (scores.argmax(axis=1) == plain.argmax(axis=1)).all()
    assert np.allclose(scores - scores[:, :1], plain - plain[:, :1], rtol=1e-4, atol=1e-4)


def test_wide_fit_of_24_components_is_right_on_its_rows():
    rng = np.random.default_rng(19)
    x, labels = rng.normal(size=(40, 2560)), np.tile([1, 3], 20)
    p = pls.simpls(grams(x, labels), 24)
    head = pls.discriminant(grams(x, labels), p)
    scores = x @ head.coef + head.intercept
    assert p.weights.shape[1] <= 24 and np.isfinite(scores).all()
    assert (np.array(head.classes)[scores.argmax(axis=1)] == labels).all()


def test_fit_on_a_table(spark):
    rng = np.random.default_rng(4)
    rows = [([float(v) for v in rng.normal(size=6) + 2.5 * np.eye(6)[c]], c) for c in (1, 2, 5) for _ in range(50)]
    tok = spark.createDataFrame(rows, "feat array<double>, class_id long").repartition(4)
    head = pls.fit_pls_lda(tok, 6)
    assert head.classes == [1, 2, 5]
    right = [r.class_id == r.p for r in features.ridge_scores(tok, head).select("class_id", features.first_best("scores", head.classes).alias("p")).collect()]
    assert np.mean(right) > 0.9
    x, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    same = pls.discriminant(grams(x, labels), pls.simpls(grams(x, labels), 2))
    assert np.allclose(head.coef, same.coef) and np.allclose(head.intercept, same.intercept)


def test_constant_columns_and_odd_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "feat array<double>, class_id long")
    head = pls.fit_pls_lda(make([([1.0, 0.0], 1), ([1.0, 0.2], 1), ([1.0, 3.0], 2), ([1.0, 3.1], 2)]), 2)
    assert np.isfinite(head.coef).all() and head.coef[0].tolist() == [0.0, 0.0]
    for bad in ([([1.0, float("nan")], 1), ([1.0, 2.0], 2)], [([1.0], 1), ([2.0], 2)], [([1.0, 2.0], 1), ([2.0, 1.0], 1)], [([1.0, 2.0], 0), ([2.0, 1.0], 1)], [([1.0, 2.0], None), ([2.0, 1.0], 1)]):
        with pytest.raises(ValueError):
            pls.fit_pls_lda(make(bad), 2)
