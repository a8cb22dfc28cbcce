"""Feature aggregates, channel ranking and small linear heads over (vec_id, ch, v) channel rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.durable import stash

STD_FLOOR = 1e-4


def channel_stats(ch: DataFrame, floor: float = STD_FLOOR) -> DataFrame:
    """(ch, mean, std): population standard deviation, not below the floor."""
    return ch.groupBy("ch").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(floor)).alias("std"))


def contrasts(ch: DataFrame) -> DataFrame:
    """(class_id, ch, contrast): |mean of z in the class - mean outside|, from per-class sums alone.

    The samples are aggregated once to a row for each class and channel; the rest works on that table.
    """
    per = ch.groupBy("class_id", "ch").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    own = Window.partitionBy("ch")
    n, s, q = (F.sum(c).over(own) for c in ("n", "s", "q"))
    per = per.withColumns({"all_n": n, "all_s": s, "all_q": q})
    std = F.greatest(F.sqrt(F.greatest(F.col("all_q") / F.col("all_n") - F.pow(F.col("all_s") / F.col("all_n"), 2), F.lit(0.0))), F.lit(STD_FLOOR))
    gap = F.col("s") / F.col("n") - (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))
    return per.where("all_n > n").select("class_id", "ch", F.abs(gap / std).alias("contrast"))


def top_channels(contrast: DataFrame, k: int) -> DataFrame:
    """(class_id, rank, ch): each class's k channels of the largest contrast, ties to the lower channel."""
    order = Window.partitionBy("class_id").orderBy(F.round("contrast", 9).desc(), "ch")
    return contrast.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("class_id", "rank", "ch")


def class_statistics(tok: DataFrame, channels: int, shrink: float = 0.2, ridge: float = 0.0025) -> DataFrame:
    """(i, j, cov), i <= j: covariance of the first channels pooled over classes, off-diagonals shrunk towards 0, a ridge on the diagonal.

    tok: (feat, class_id). From the classes' packed Gram matrices, which meet in the task that writes the result.
    """
    grams = gram_rows(tok.select(F.slice("feat", 1, channels).alias("feat"), "class_id", F.lit(0).alias("fold")), channels, "fold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n = np.zeros((channels, channels)), 0.0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                g = np.frombuffer(packed).reshape(channels + 1, -1)
                c, n = c + g[:-1, :-1] - np.outer(g[-1, :-1], g[-1, :-1]) / g[-1, -1], n + g[-1, -1]
        if n:
            i, j = np.triu_indices(channels)
            cov = np.where(i == j, c[i, j] / n + ridge, c[i, j] / n * (1 - shrink))
            for at in range(0, len(i), 1 << 16):
                cut = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(i[cut]), pa.array(j[cut]), pa.array(cov[cut])], ["i", "j", "cov"])

    return grams.select("g").coalesce(1).mapInArrow(run, "i long, j long, cov double")


def _grams(width: int, classes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, t = np.zeros((width + 1, width + 1)), np.zeros((width + 1, len(classes)))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
            y = np.where(batch.column(1).to_numpy(zero_copy_only=False)[:, None] == np.array(classes)[None], 1.0, -1.0)
            w = batch.column(2).to_numpy(zero_copy_only=False)[:, None]
            g += x.T @ (w * x)
            t += x.T @ (w * y)
        flat = np.concatenate((g.ravel(), t.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    return run


class Ridge:
    """One-vs-rest ridge on +-1 targets: scores are feat @ coef + intercept, a column a class."""

    def __init__(self, classes: list[int], coef: np.ndarray, intercept: np.ndarray):
        self.classes, self.coef, self.intercept = classes, coef, intercept


def fit_ridge(tok: DataFrame, width: int, alpha: float = 10.0, balanced: bool = True) -> Ridge:
    """Solve the weighted normal equations with a free intercept.

    Each partition reduces its rows to one Gram matrix of (width + 1) squared numbers, which are summed on the
    executors; the driver solves a system of the channels' size. Weights n_c ** -0.5 over their mean, or 1.
    """
    counts = {r[0]: r[1] for r in tok.groupBy("class_id").count().collect()}
    classes = sorted(counts)
    raw = {c: counts[c] ** -0.5 if balanced else 1.0 for c in classes}
    mean = sum(raw[c] * counts[c] for c in classes) / sum(counts.values())
    weight = F.element_at(F.create_map(*(F.lit(v) for c in classes for v in (c, raw[c] / mean))), F.col("class_id"))
    rows = tok.select("feat", "class_id", weight.alias("w")).mapInArrow(_grams(width, classes), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros((width + 1) * (width + 1 + len(classes)))
    flat[rows["i"]] = rows["v"]
    g, t = flat[: (width + 1) ** 2].reshape(width + 1, -1), flat[(width + 1) ** 2 :].reshape(width + 1, -1)
    penalty = np.full(width + 1, alpha)
    penalty[-1] = 0
    b = np.linalg.solve(g + np.diag(penalty), t)
    return Ridge(classes, b[:-1], b[-1])


def ridge_scores(tok: DataFrame, head: Ridge) -> DataFrame:
    """(vec_id, scores array by class): a dot product a class, on the JVM."""
    dots = [F.aggregate(F.zip_with("feat", F.array(*(F.lit(float(v)) for v in head.coef[:, k])), lambda a, b: a.cast("double") * b), F.lit(float(head.intercept[k])), lambda s, v: s + v) for k in range(len(head.classes))]
    return tok.select("*", F.array(*dots).alias("scores"))


def first_best(scores: str, classes: list[int]):
    """The class of the largest score; ties to the first class."""
    return F.element_at(F.array(*(F.lit(c) for c in classes)), F.array_position(F.col(scores), F.array_max(scores)).cast("int"))


def centroid_head(ch: DataFrame, k: int) -> DataFrame:
    """(class_id, ch, coef, intercept): nearest-centroid scores 2 c x - |c|^2 on the k channels whose class means vary most."""
    means = ch.groupBy("class_id", "ch").agg(F.avg("v").alias("c"))
    top = means.groupBy("ch").agg(F.var_pop("c").alias("s")).orderBy(F.round("s", 12).desc(), "ch").limit(k).select("ch")
    kept = means.join(F.broadcast(top), "ch")
    norm = -F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("class_id"))
    return kept.select("class_id", "ch", (2 * F.col("c")).alias("coef"), norm.alias("intercept"))


def threshold_sweep(margins: DataFrame, populations: dict[int, float], positive: int, sensitivity: float) -> DataFrame:
    """(threshold, sensitivity, specificity, dice): the cut `margin >= threshold` of the largest specificity at that sensitivity.

    margins: (margin, class_id), two classes. Both are shares of their own class, so weighting the classes to their
    populations changes neither; populations must cover the rows, and weigh the dice that comes with the cut. Ties go to the largest threshold. Rows are reduced to one for each distinct margin; those are dealt in ranges, summed up within each, and
    shifted by the sums of the ranges above: only a row a range meets in one task.
    """
    per = margins.groupBy("margin").agg(F.count_if(F.col("class_id") == positive).alias("tp"), F.count_if(F.col("class_id") != positive).alias("fp"))
    per = stash(per.repartitionByRange(F.desc("margin")).withColumn("range", F.spark_partition_id()))
    sums = per.groupBy("range").agg(F.sum("tp").alias("a"), F.sum("fp").alias("b"))
    above, every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "ab"), F.sum("a").over(every).alias("p"), F.sum("b").over(every).alias("n"))
    down = Window.partitionBy("range").orderBy(F.desc("margin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = per.select("range", "margin", F.sum("tp").over(down).alias("tp"), F.sum("fp").over(down).alias("fp")).join(F.broadcast(sums), "range")  # a row a range
    share = ((F.col("tp") + F.col("a_above")) / F.col("p"), (F.col("fp") + F.col("b_above")) / F.col("n"))
    size = [F.lit(float(v)) if v else F.col(c) for c, v in (("p", populations.get(positive)), ("n", sum(v for k, v in populations.items() if k != positive)))]
    uncovered = (size[0] < F.col("p")) | (size[1] < F.col("n"))
    true, false = (s * w for s, w in zip(share, size, strict=True))
    dice = F.when(uncovered, F.raise_error(F.lit("populations must cover the rows"))).otherwise(2 * true / (true + false + size[0]))
    c = c.select(F.col("margin").alias("threshold"), share[0].alias("sensitivity"), (1 - share[1]).alias("specificity"), dice.alias("dice"))
    return c.where(F.col("sensitivity") >= sensitivity).orderBy(F.desc("specificity"), F.desc("threshold")).limit(1)


def _class_grams(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One matrix a fold and class, packed: x'x of rows with a one behind them; its last row holds sums and the count."""
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)], axis=1)
            for fold, label in np.unique(key, axis=0).tolist():
                own = x[(key == (fold, label)).all(axis=1)]
                total[fold, label] = total.get((fold, label), 0) + own.T @ own
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array([total[k].tobytes() for k in keys], pa.binary())], ["fold", "class_id", "g"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for fold, label, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[fold, label] = total.get((fold, label), 0) + np.frombuffer(g)
    if total:
        keys = list(total)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array([total[k].tobytes() for k in keys], pa.binary())], ["fold", "class_id", "g"])


def class_grams(tok: DataFrame, width: int, fold: str) -> dict[tuple[int, int], np.ndarray]:
    """By fold and class the (width + 1) squared products of tok's rows (feat, class_id), in one pass over them.

    Partitions hand on one packed matrix a fold and class, which are added in tasks of their own; the driver gets their sums.
    """
    return {(r.fold, r.class_id): np.frombuffer(r.g).reshape(width + 1, -1) for r in gram_rows(tok, width, fold).collect()}


def gram_products(tok: DataFrame, width: int) -> DataFrame:
    """(class_id, i, j, v), i <= j: each class's sums of products of channels, `width` standing for a one; written by the tasks that hold the sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(width + 1)
        for batch in batches:
            for label, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.frombuffer(packed).reshape(width + 1, -1)[i, j]
                for at in range(0, len(v), 1 << 16):
                    cut = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v[cut]), label)), pa.array(i[cut]), pa.array(j[cut]), pa.array(v[cut])], ["class_id", "i", "j", "v"])

    rows = gram_rows(tok.select("feat", "class_id", F.lit(0).alias("fold")), width, "fold")
    return rows.select("class_id", "g").mapInArrow(run, "class_id long, i long, j long, v double")


def gram_rows(tok: DataFrame, width: int, fold: str) -> DataFrame:
    """class_grams() as a table (fold, class_id, g), a packed matrix a row."""
    kind = "fold long, class_id long, g binary"
    rows = tok.select("feat", F.col(fold).cast("long").alias("fold"), F.col("class_id").cast("long").alias("class_id")).mapInArrow(_class_grams(width), kind)
    return rows.repartition("fold", "class_id").mapInArrow(_added, kind)


def ridge_of(grams: dict[tuple[int, int], np.ndarray], folds: Sequence[int], alpha: float, balanced: bool = True) -> Ridge:
    """The ridge head of fit_ridge() on the rows of some folds, from class_grams() alone."""
    per: dict[int, np.ndarray] = {}
    for (fold, label), g in grams.items():
        if fold in folds:
            per[label] = per.get(label, 0) + g
    classes = sorted(per)
    counts = {c: per[c][-1, -1] for c in classes}
    raw = {c: counts[c] ** -0.5 if balanced else 1.0 for c in classes}
    mean = sum(raw[c] * counts[c] for c in classes) / sum(counts.values())
    g = sum(per[c] * (raw[c] / mean) for c in classes)
    t = np.stack([sum(per[o][:, -1] * (raw[o] / mean) * (1.0 if o == c else -1.0) for o in classes) for c in classes], axis=1)
    penalty = np.full(len(g), alpha)
    penalty[-1] = 0
    b = np.linalg.solve(g + np.diag(penalty), t)
    return Ridge(classes, b[:-1], b[-1])


def block_digests(cells: DataFrame, label: str, block: int) -> DataFrame:
    """(label, digest): SHA-256 over a label's blocks in order, each by the SHA-256 of its cells in order."""
    listed = lambda items, *fields: F.array_join(F.transform(F.sort_array(F.collect_list(items)), lambda s: F.concat_ws(",", *(s[f].cast("string") for f in fields))), ";")
    own = cells.groupBy(label, F.expr(f"y div {block}").alias("by"), F.expr(f"x div {block}").alias("bx")).agg(F.sha2(listed(F.struct("y", "x"), "y", "x"), 256).alias("d"))
    return own.groupBy(label).agg(F.sha2(listed(F.struct("by", "bx", "d"), "by", "bx", "d"), 256).alias("digest"))
