"""Channel selection and held-out ridge from distributed moments; the driver sees matrices of the channels' size only."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _dense(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _summed(df: DataFrame, run) -> dict[tuple[int, int], float]:
    got = df.mapInArrow(run, "g int, i long, v double").groupBy("g", "i").agg(F.sum("v").alias("v")).toPandas()
    return {g: part.sort_values("i")["v"].to_numpy() for g, part in got.groupby("g")}


def moments(tok: DataFrame, label: str = "class_id", features: str = "feat") -> tuple[dict[int, tuple[float, np.ndarray, np.ndarray]], np.ndarray]:
    """Of each class (n, sums, sums of squares), and the sum of outer products over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _dense(b.column(0), b.num_rows), b.column(1).to_numpy(zero_copy_only=False)
            for c in np.unique(y):
                z = x[y == c]
                own = np.concatenate(([len(z)], z.sum(axis=0), np.square(z).sum(axis=0)))
                per[int(c)] = per.get(int(c), 0) + own
            per[-1] = per.get(-1, 0) + (x.T @ x).ravel()
        for c, v in per.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(np.arange(len(v))), pa.array(np.asarray(v, np.float64))], ["g", "i", "v"])

    got = _summed(tok.select(features, F.col(label).cast("int")), run)
    outer = got.pop(-1)
    width = int(round(len(outer) ** 0.5))
    return {c: (v[0], v[1 : width + 1], v[width + 1 :]) for c, v in sorted(got.items())}, outer.reshape(width, width)


def pairwise_relevance(per: dict, guard: float = 0.01) -> np.ndarray:
    """A row for each pair of classes: squared gap of the standardized means over their variances plus a guard."""
    n = sum(v[0] for v in per.values())
    mean = sum(v[1] for v in per.values()) / n
    std = np.sqrt(np.maximum(sum(v[2] for v in per.values()) / n - mean**2, 0))
    std[std == 0] = 1
    m = {c: (v[1] / v[0] - mean) / std for c, v in per.items()}
    var = {c: np.maximum(v[2] / v[0] - (v[1] / v[0]) ** 2, 0) / std**2 for c, v in per.items()}
    return np.array([(m[a] - m[b]) ** 2 / (var[a] + var[b] + guard) for a, b in combinations(per, 2)])


def correlations(per: dict, outer: np.ndarray) -> np.ndarray:
    """Correlation of every two channels; 0 where one is constant."""
    n, total = sum(v[0] for v in per.values()), sum(v[1] for v in per.values())
    cov = outer / n - np.outer(total / n, total / n)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.outer(sd, sd)
    return np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 1e-15)


def select_pairwise(tok: DataFrame, count: int, pool: int = 128, damp: float = 0.85, label: str = "class_id", features: str = "feat") -> list[int]:
    """`count` channels, taken by the pairs of classes in turn.

    A pair takes the channel of the largest relevance times (1 - damp * its largest |correlation| with those taken), out
    of the channels that are among some pair's `pool` most relevant; ties to the lower channel.
    """
    per, outer = moments(tok, label, features)
    relevance, corr = pairwise_relevance(per), np.abs(correlations(per, outer))
    open_ = np.zeros(relevance.shape[1], bool)
    for row in relevance:
        open_[np.argsort(-row, kind="stable")[:pool]] = True
    if open_.sum() < count:
        raise ValueError("fewer channels than asked for")
    worst, taken = np.zeros(len(open_)), []
    while len(taken) < count:
        row = relevance[len(taken) % len(relevance)]
        best = int(np.argmax(np.where(open_, row * (1 - damp * worst), -np.inf)))
        taken.append(best)
        open_[best] = False
        worst = np.maximum(worst, corr[best])
    return taken


def round_robin(relevance: np.ndarray, persistence: dict[int, float], count: int, floor: float = 0.05) -> list[int]:
    """Each pair of classes in turn takes its best channel left, by relevance * (floor + persistence); ties to the lower."""
    weight = floor + np.array([persistence.get(c) or 0.0 for c in range(relevance.shape[1])])
    order = [iter(np.argsort(-row * weight, kind="stable").tolist()) for row in relevance]
    taken: list[int] = []
    count = min(count, relevance.shape[1])
    while len(taken) < count:
        turn = order[len(taken) % len(order)]
        taken.append(next(c for c in turn if c not in taken))
    return taken


def fold_ridge(rows: DataFrame, alpha: float, x: str = "x", y: str = "y", fold: str = "fold") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each fold the multi-output ridge (coef, intercept) fitted on all other folds.

    One pass gives each fold's Gram sums; a fold's training sums are the total less its own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per: dict[int, np.ndarray] = {}
        shape: dict[int, tuple[int, int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            u, v, f = _dense(b.column(0), b.num_rows), _dense(b.column(1), b.num_rows), b.column(2).to_numpy(zero_copy_only=False)
            u = np.concatenate((u, np.ones((len(u), 1))), axis=1)
            for k in np.unique(f):
                own = f == k
                g = np.concatenate(((u[own].T @ u[own]).ravel(), (u[own].T @ v[own]).ravel(), [u.shape[1], v.shape[1]]))
                shape[int(k)] = u.shape[1], v.shape[1]
                per[int(k)] = per.get(int(k), 0) + g
        for k, g in per.items():
            g = np.asarray(g[:-2])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(np.arange(len(g))), pa.array(g)], ["g", "i", "v"])

    sums = _summed(rows.select(x, y, F.col(fold).cast("int")), run)
    size = rows.select(F.size(x), F.size(y)).first()
    p, q = size[0] + 1, size[1]
    total = sum(sums.values())
    penalty = np.diag([alpha] * (p - 1) + [0.0])
    out = {}
    for k, own in sums.items():
        rest = total - own
        b = np.linalg.solve(rest[: p * p].reshape(p, p) + penalty, rest[p * p :].reshape(p, q))
        out[int(k)] = b[:-1], b[-1]
    return out
