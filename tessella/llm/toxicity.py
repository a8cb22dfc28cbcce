"""Toxicity by non-negative positive-unlabelled learning on word and prefix features."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import batches_of, stash, unit_hash

PREFIXES = (4, 5, 6)
CACHE = 400_000


def core(word: str) -> str:
    i, j = 0, len(word)
    while i < j and not word[i].isalnum():
        i += 1
    while j > i and not word[j - 1].isalnum():
        j -= 1
    return word[i:j]


def features(word: str) -> list[str]:
    """A word and its prefixes (marked by a trailing *): stems are caught under endings never seen."""
    word = core(word)
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)] if word else []


class Scorer:
    """Sparse logistic model over the presence of features; words are looked up once and kept."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.at = {x: i for i, x in enumerate(names)}
        self.weights, self.bias = weights, bias

    def ids(self, text: str | None, cache: dict[str, tuple[int, ...]]) -> list[int]:
        found: set[int] = set()
        words = set((text or "").lower().split())
        if len(cache) > CACHE:
            cache.clear()
        for w in words:
            hit = cache.get(w)
            if hit is None:
                hit = cache[w] = tuple(i for f in features(w) if (i := self.at.get(f)) is not None)
            if hit:
                found.update(hit)
        return sorted(found)

    def score(self, text: str | None, cache: dict[str, tuple[int, ...]]) -> float:
        z = self.bias + float(self.weights[self.ids(text, cache)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative positive-unlabelled risk of logits z under the logistic loss, and the way to step in each logit.

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)). Where the estimated risk of the unlabelled as negatives falls below 0,
    the step goes up that term instead.
    """
    p, u = z[positive], z[~positive]
    as_negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
    value = prior * np.logaddexp(0, -p).mean() + max(0.0, as_negative)
    s, out = 1 / (1 + np.exp(-np.clip(z, -50, 50))), np.empty(len(z))
    down_p, down_u = -prior * s[positive] / len(p), s[~positive] / len(u)
    if as_negative >= 0:
        out[positive], out[~positive] = prior * (s[positive] - 1) / len(p) + down_p, down_u
    else:
        out[positive], out[~positive] = -down_p, -down_u
    return float(value), out


def nnpu(x: list[list[int]], positive: np.ndarray, scale: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the least risk() by Adam; row i has the features x[i], each of its scale's value."""
    lens = np.array([len(r) for r in x])
    flat = np.array([i for r in x for i in r], np.int64)
    owner, value, width = np.repeat(np.arange(len(x)), lens), scale[flat], len(scale)
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        _, g = risk(b + np.bincount(owner, w[flat] * value, len(x)), positive, prior)
        gw, gb = np.bincount(flat, g[owner] * value, width) + decay * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w * scale, float(b)


def cut(z: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """The logit above which a row counts as positive: where the same risk, under the zero-one loss, is least.

    Of equally good places the middle of the widest gap between logits.
    """
    e = np.unique(z)
    places = np.concatenate(([e[0] - 1], (e[1:] + e[:-1]) / 2, [e[-1] + 1]))
    p, u = np.sort(z[positive]), np.sort(z[~positive])
    missed, taken = np.searchsorted(p, places) / len(p), 1 - np.searchsorted(u, places) / len(u)
    value = prior * missed + np.maximum(0.0, taken - prior * (1 - missed))
    best = np.flatnonzero(value <= value.min() + 1e-12)
    gap = np.concatenate(([0.0], np.diff(e), [0.0]))
    return float(places[best[np.argmax(gap[best])]])


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def out() -> pa.RecordBatch:
        rows = [(f, p, c) for p in counts for f, c in counts[p].items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], ["f", "p", "c"])

    for batch in batches_of(batches, 0):
        for text, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[p].update({f for w in set((text or "").lower().split()) for f in features(w)})
            if sum(map(len, counts.values())) > 200_000:
                yield out()
                counts = {True: Counter(), False: Counter()}
    if any(counts.values()):
        yield out()


def evidence(a: Column, b: Column, n_p: int, n_u: int) -> Column:
    """How surely a feature speaks for the positives: the log ratio of its shares in a of n_p and b of n_u, less 2.8 standard errors."""
    ratio = F.log(((a + 0.8) / n_p) / ((b + 0.8) / n_u))
    return ratio - math.sqrt(8) * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def fit(docs: DataFrame, labels: DataFrame, positives: int = 4_000, unlabelled: int = 8_000, doc_id: str = "doc_id", text: str = "text") -> Scorer:
    """Learn from docs and labels (doc_id, toxic); pass training rows only.

    Positives: rows with a label toxic = 1. Unlabelled: any other rows; their class prior is the share of 1 among non-null
    labels, times the share of them without a label. All features with evidence() for the positives take part, each with
    that evidence as its value; of texts with one least shingle hash (copies, most near copies) one counts. The logit at
    which a score is 0.5 is the one of the least zero-one risk, see cut(). Bounds, both parameters: about so many positives
    and unlabelled rows, those whose hash of doc_id is low enough. Without positives or without unlabelled rows every score
    is the prior (one half if there is no label). A repeated doc_id has
    the greatest of its labels; about one of its rows is taken, by a hash of the text.
    """
    marks = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen, hits = marks.agg(F.count("*"), F.sum(F.col("toxic"))).first()
    prior = min(max((hits or 0) / seen, 1e-3), 0.999) if seen else 0.5
    ids = docs.groupBy(F.col(doc_id).alias("doc_id")).agg(F.count("*").alias("m")).join(marks, "doc_id", "left")
    ids = ids.select("doc_id", "m", (F.coalesce("toxic", F.lit(0)) == 1).alias("p"), F.col("toxic").isNotNull().alias("told"))
    size = {(bool(r[0]), bool(r[1])): r[2] for r in ids.groupBy("p", "told").count().collect()}
    count = {p: size.get((p, True), 0) + size.get((p, False), 0) for p in (True, False)}
    hidden = max(prior * size.get((False, False), 0) / max(count[False], 1), 1e-4)  # positives among the unlabelled
    share = F.when(F.col("p"), positives / max(count[True], 1)).otherwise(unlabelled / max(count[False], 1))
    ids = ids.where(unit_hash(F.col("doc_id").cast("string")) < share).select("doc_id", "p", "m")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.where((F.col("m") == 1) | (unit_hash(F.xxhash64("text")) < 1 / F.col("m"))).drop("m")
    # copies and near copies would lend their words undue weight: of rows with one least shingle hash, one stays
    rows = rows.withColumn("w", F.split(F.lower("text"), r"\s+"))
    shingle = lambda i: F.xxhash64(F.array_join(F.slice("w", i, 5), " "))
    least_hash = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), shingle))
    rows = stash(rows.groupBy(least_hash.alias("k")).agg(F.max(F.struct("p", "text")).alias("r")).select("r.text", "r.p"))
    n = dict(rows.groupBy("p").count().collect())
    if not (n.get(True) and n.get(False)):
        return Scorer([], np.zeros(0), float(np.log(prior / (1 - prior))))
    counts = rows.mapInArrow(_presence, "f string, p boolean, c long").groupBy("f").agg(
        F.sum(F.when(F.col("p"), F.col("c")).otherwise(0)).alias("a"), F.sum(F.when(F.col("p"), 0).otherwise(F.col("c"))).alias("b"))
    found_ = counts.select("f", evidence(F.col("a"), F.col("b"), n[True], n[False]).alias("e")).where("e > 0").toArrow().sort_by("f")
    names, scale = found_.column("f").to_pylist(), found_.column("e").to_numpy()
    blank = Scorer(names, np.zeros(len(names)), 0.0)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches_of(batches, 0):
            x = [blank.ids(t, cache) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())), batch.column(1)], ["x", "p"])

    table = rows.mapInArrow(found, "x array<int>, p boolean").toArrow()
    x, p = table.column("x").to_pylist(), np.array(table.column("p").to_pylist(), bool)
    order = sorted(range(len(x)), key=lambda i: (bool(p[i]), x[i]))  # reruns agree, whatever the row order
    x, p = [x[i] for i in order], p[order]
    w, b = nnpu(x, p, scale, hidden)
    z = np.array([b + w[r].sum() for r in x])
    return Scorer(names, w, b - cut(z, p, hidden))


def score(docs: DataFrame, model: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row, of its whole text; a null text scores as an empty one. Repeated rows give repeated rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches_of(batches, 1):
            s = np.array([held.value.score(t, cache) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return chosen.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
