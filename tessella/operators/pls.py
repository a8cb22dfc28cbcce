"""Partial least squares (SIMPLS) with a linear discriminant on its scores, from class Gram matrices alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.features import Ridge, class_grams

COMPONENTS = 24  # at most. A fixed value.
JITTER = 1e-10  # of the within-class scatter's mean diagonal, so that a fit without error can be inverted


class Projection:
    """z = (x - mean) / scale, scores z @ weights; a column a component."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights


def _scaled(g: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of a packed Gram matrix the scatter about the rows' own mean, that mean, and the number of rows; columns scaled."""
    n, mean = g[-1, -1], g[-1, :-1] / g[-1, -1]
    return (g[:-1, :-1] - n * np.outer(mean, mean)) / np.outer(scale, scale), mean, n


def simpls(grams: dict[int, np.ndarray], components: int) -> Projection:
    """The components of autoscaled rows that covary most with class membership, each orthogonal to those before.

    grams: by class, of rows with a one behind them. Only cross-products enter, so rows may be any number, fewer than columns
    too. Deflation takes each loading out of the cross-product; it ends early when nothing is left.
    """
    total = sum(grams.values())
    raw, mean, n = _scaled(total, np.ones(len(total) - 1))
    scale = np.sqrt(np.maximum(np.diag(raw), 0) / max(n - 1, 1))
    scale[scale <= 1e-12 * np.maximum(1, np.abs(mean))] = 1.0
    scatter = raw / np.outer(scale, scale)
    s = np.stack([(g[-1, :-1] - g[-1, -1] * mean) / scale for _, g in sorted(grams.items())], axis=1)
    begun, basis, weights = np.linalg.norm(s), np.zeros((len(mean), 0)), []
    for _ in range(components):
        if np.linalg.norm(s) <= 1e-10 * begun:
            break
        r = s @ np.linalg.eigh(s.T @ s)[1][:, -1]
        size = float(r @ scatter @ r)
        if size <= 1e-12 * float(r @ r) * np.trace(scatter) / len(mean):
            break
        r /= np.sqrt(size)
        v = scatter @ r
        for _ in range(2):
            v -= basis @ (basis.T @ v)
        v /= np.linalg.norm(v)
        s = s - np.outer(v, v @ s)
        basis = np.column_stack((basis, v))
        weights.append(r)
    return Projection(mean, scale, np.stack(weights, axis=1) if weights else np.zeros((len(mean), 0)))


def discriminant(grams: dict[int, np.ndarray], p: Projection) -> Ridge:
    """Linear discriminants of the scores, with the classes' shares as priors, as one head on the features themselves."""
    classes, n = sorted(grams), sum(g[-1, -1] for g in grams.values())
    within, means, prior = 0.0, [], []
    for c in classes:
        scatter, mean, own = _scaled(grams[c], p.scale)
        within = within + p.weights.T @ scatter @ p.weights
        means.append(((mean - p.mean) / p.scale) @ p.weights)
        prior.append(np.log(own / n))
    within /= max(n - len(classes), 1)
    m = np.stack(means, axis=1)
    k = len(within)
    axes = np.linalg.solve(within + np.eye(k) * (JITTER * np.trace(within) / k + 1e-12), m) if k else m
    coef = (p.weights @ axes) / p.scale[:, None]
    return Ridge(classes, coef, np.array(prior) - 0.5 * (m * axes).sum(axis=0) - p.mean @ coef)


def fit_pls_lda(tok: DataFrame, width: int, components: int | None = None) -> Ridge:
    """A head on (feat, class_id): SIMPLS to min(24, classes - 1, columns, rows - 1) components, or so many, and a discriminant.

    The executors reduce rows to one Gram matrix a class; the driver's algebra is of the columns' size. Targets are integers of 1
    to 255, two classes at least, features finite; else an error. Use it by features.ridge_scores() and first_best().
    """
    odd = ~F.col("class_id").between(1, 255) | F.col("class_id").isNull() | (F.size("feat") != width) | F.exists("feat", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    if not tok.where(F.coalesce(odd, F.lit(True))).isEmpty():
        raise ValueError("finite features of the stated width and targets of 1 to 255 are needed")
    grams = {c: g for (_, c), g in class_grams(tok.withColumn("fold", F.lit(0)), width, "fold").items()}
    if len(grams) < 2:
        raise ValueError("two classes at least are needed")
    rows = int(sum(g[-1, -1] for g in grams.values()))
    return discriminant(grams, simpls(grams, components or min(COMPONENTS, len(grams) - 1, width, rows - 1)))
