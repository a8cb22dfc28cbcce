"""Hard negatives by exact inner products: vectors sorted by (pivot, distance), searched in key intervals that expand."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stash

PAGE, DIRECTORY = 1024, 1 << 16  # rows of a page, at least; pages beyond which they hold more rows instead
ASKED = 256  # anchors of a block
SAMPLE, PIVOTS, ROWS_A_PIVOT, STEPS = 4096, 64, 4096, 4  # rows that pivots are fitted on; pivots at most; rows for each; rounds of the fit
START, GROWTH = 8, 8  # pages that an anchor scans first; how their number grows from round to round
EXACT, MOST = 1 << 53, 1 << 62  # squared lengths whose sums are exact in doubles, in longs
HITS = "row long, w long, lo long, hi long, id long, score long"


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def augmented(x: np.ndarray, longest: int) -> np.ndarray:
    """Rows with one more component, which makes all as long as the longest: the nearest to a query is that of the largest inner product."""
    x = x.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def fit_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """n centres of the sampled rows, from rows far from each other, moved to their groups' means."""
    at, gap = [0], np.full(len(x), np.inf)
    while len(at) < min(n, len(x)):
        gap = np.minimum(gap, ((x - x[at[-1]]) ** 2).sum(axis=1))
        at.append(int(gap.argmax()))
    centres = x[at]
    for _ in range(STEPS):
        own = distances(x, centres).argmin(axis=1)
        centres = np.stack([x[own == k].mean(axis=0) if (own == k).any() else c for k, c in enumerate(centres)])
    return centres


def _keyed(width: int, longest: int, pivots: np.ndarray):
    """Each row's nearest pivot and its distance from it: the key by which rows are stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                d = distances(augmented(_matrix(batch.column("x"), width), longest), pivots)
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])], [*batch.schema.names, "pivot", "dist"])

    return run


def _paged(width: int, rows: int):
    """Pages of consecutive rows of one pivot, as packed arrays; a page is an interval [low, high] of the key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # pivot, distances, (id, label, row), components

        def page() -> pa.RecordBatch:
            nonlocal made
            d, key, x = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            x = x.astype(np.int32) if len(x) and np.abs(x).max() < 1 << 31 else x
            made += 1
            values = ((part << 32) + made, held[0][0], d[0], d[-1], len(d), np.ascontiguousarray(key.T).tobytes(), x.tobytes())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["page", "pivot", "low", "high", "n", "key", "x"])

        for batch in batches:
            x, pivot, d = _matrix(batch.column("x"), width), batch.column("pivot").to_numpy(), batch.column("dist").to_numpy()
            key = np.column_stack([batch.column(c).to_numpy() for c in ("id", "label", "row")])
            at = 0
            while at < len(pivot):
                if held and held[0][0] != pivot[at]:
                    yield page()
                room = rows - sum(len(h[1]) for h in held)
                end = min(at + room, int(np.searchsorted(pivot, pivot[at], "right")))
                held.append((int(pivot[at]), d[at:end], key[at:end], x[at:end]))
                if end - at == room:
                    yield page()
                at = end
        if held:
            yield page()

    return run


PAGED = "page long, pivot int, low double, high double, n int, key binary, x binary"


def _unpacked(n: int, key: bytes, x: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels, rows and components of a page."""
    ids, labels, rows = np.frombuffer(key, np.int64).reshape(3, n)
    return ids, labels, rows, np.frombuffer(x, np.int32 if len(x) == 4 * n * width else np.int64).reshape(n, width)


def _needed(width: int, longest: int, pivots: np.ndarray, directory, first: int, last: int):
    """(ask, page, who): the pages that a block's anchors scan in this round.

    Each anchor takes pages by the gap between its own distance from the pivot and their interval, from place `first` to `last`, but
    those alone whose bounds on a score meet one of its windows above what it has found there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages, pivot, low, high = directory.value
        for batch in batches:
            for b in batch.to_pylist():
                _, _, rows, x = _unpacked(b["n"], b["key"], b["x"], width)
                place = {r: i for i, r in enumerate(rows.tolist())}
                states: list[list[tuple[int, int]]] = [[] for _ in rows]
                for s in b["state"]:
                    states[place[s["row"]]].append((s["floor"], s["hi"]))
                who: dict[int, list[int]] = {}
                q = np.column_stack((x.astype(np.float64), np.zeros(len(x))))
                to = distances(q, pivots)
                for i, windows in enumerate(states):
                    if not windows:
                        continue
                    own = to[i][pivot]
                    gap = np.maximum(0.0, np.maximum(own - high, low - own))
                    order = np.lexsort((pages, own, gap))[first:last]
                    base = float((q[i] * q[i]).sum()) + longest
                    slack = 1e-6 * (1 + base)
                    best, worst = (base - gap[order] ** 2) / 2 + slack, (base - (own[order] + high[order]) ** 2) / 2 - slack
                    meets = np.zeros(len(order), bool)
                    for floor, hi in windows:
                        meets |= (best >= floor) & (worst <= hi)
                    for p in order[meets].tolist():
                        who.setdefault(p, []).append(i)
                for some in range(0, len(keys := list(who)), 4096):
                    part = keys[some : some + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([b["page"]] * len(part), pa.int64()), pa.array([int(pages[p]) for p in part], pa.int64()), pa.array([np.array(who[p], np.int32).tobytes() for p in part], pa.binary())], ["ask", "to", "who"])

    return run


def _best(score: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best that fit: higher scores first, ties by smaller id."""
    at = np.flatnonzero(fits)
    if len(at) > 4 * k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _scored(width: int, longest: int, same: bool, k: int):
    """Of each (block of anchors, page) the k best of each anchor's windows, by whole inner products."""
    kind = np.float64 if longest < EXACT else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                who = np.frombuffer(b["who"], np.int32)
                _, labels, rows, x = _unpacked(b["n"], b["key"], b["x"], width)
                ids, others, places, y = _unpacked(b["page_n"], b["page_key"], b["page_x"], width)
                scores = (x[who].astype(kind) @ y.astype(kind).T).astype(np.int64)
                windows: dict[int, list[dict]] = {}
                for s in b["state"]:
                    windows.setdefault(s["row"], []).append(s)
                out: list[tuple] = []
                for i, score in zip(who.tolist(), scores, strict=True):
                    mine = (others == labels[i]) == same
                    mine &= places != rows[i]
                    for s in windows.get(int(rows[i]), ()):
                        for j in _best(score, ids, mine & (score >= s["floor"]) & (score <= s["hi"]), k).tolist():
                            out.append((s["row"], s["w"], s["lo"], s["hi"], int(ids[j]), int(score[j])))
                for at in range(0, len(out), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[at : at + (1 << 16)], strict=True)], ["row", "w", "lo", "hi", "id", "score"])

    return run


class Store:
    """Rows (row, id, label, x, asks) by (pivot, distance), in pages, and the anchors among them in blocks of the same order."""

    def __init__(self, rows: DataFrame, page: int, asked: int):
        spark = rows.sparkSession
        squares = F.aggregate("x", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
        found = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max(squares).alias("longest")).first()
        self.n, self.width, self.longest = found.n, max(1, found.width or 1), int(found.longest or 0)
        if self.longest >= MOST:
            raise ValueError("inner products of these vectors don't fit into 64 bits")
        if not self.n:
            return
        sample = np.zeros((min(SAMPLE, self.n), self.width), np.int64)
        for i, r in enumerate(rows.orderBy(F.xxhash64("id", "x"), "id", "x").select("x").limit(SAMPLE).collect()):
            sample[i, : len(r.x)] = r.x
        self.pivots = fit_pivots(augmented(sample, self.longest), max(1, min(PIVOTS, self.n // ROWS_A_PIVOT)))
        keyed = stash(rows.mapInArrow(_keyed(self.width, self.longest, self.pivots), "row long, id long, label long, x array<long>, asks boolean, pivot int, dist double"))
        ordered = lambda df: df.repartitionByRange("pivot", "dist", "row").sortWithinPartitions("pivot", "dist", "row")
        size = max(page, math.ceil(self.n / DIRECTORY))
        self.pages = stash(ordered(keyed).mapInArrow(_paged(self.width, size), PAGED))
        self.blocks = stash(ordered(keyed.where("asks")).mapInArrow(_paged(self.width, asked), PAGED)).select("page", "n", "key", "x")
        self.anchors = keyed.where("asks").select("row", "id")
        entries = self.pages.select("page", "pivot", "low", "high").collect()  # at most DIRECTORY, and one for each pivot and part
        self.directory = spark.sparkContext.broadcast(tuple(np.array([e[k] for e in entries]) for k in range(4)))
        self.count = len(entries)
        rows_of = F.udf(lambda n, key: np.frombuffer(key, np.int64)[2 * n :].tolist(), "array<long>")
        self.where = stash(self.blocks.select("page", F.explode(rows_of("n", "key")).alias("row")))

    def search(self, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """(row, w, lo, hi, id, score): of each anchor's windows (row, w, lo, hi) the k rows of the best scores in [lo, hi].

        same: rows of the anchor's own label, else of another; never the anchor itself. Exact: a round takes more pages for
        each anchor, and it ends when no page is left whose distance bound could better what is found.
        """
        windows = stash(windows)
        best = self.pages.sparkSession.createDataFrame([], HITS)
        first, last = 0, START
        while True:
            full = best.groupBy("row", "w").agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
            state = windows.join(full, ["row", "w"], "left").withColumn("floor", F.greatest("lo", "worst"))
            state = state.join(self.where, "row").groupBy("page").agg(F.collect_list(F.struct("row", "w", "lo", "hi", "floor")).alias("state"))
            blocks = stash(self.blocks.join(state, "page"))
            needs = stash(blocks.mapInArrow(_needed(self.width, self.longest, self.pivots, self.directory, first, last), "ask long, to long, who binary"))
            if not needs.isEmpty():
                cells = needs.join(blocks.withColumnRenamed("page", "ask"), "ask")
                pages = self.pages.select(F.col("page").alias("to"), F.col("n").alias("page_n"), F.col("key").alias("page_key"), F.col("x").alias("page_x"))
                hits = cells.join(pages, "to").mapInArrow(_scored(self.width, self.longest, same, k), HITS)
                order = Window.partitionBy("row", "w").orderBy(F.desc("score"), "id")
                best = stash(best.unionByName(hits).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place"))
            if last >= self.count:
                return best
            first, last = last, last * GROWTH


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: float = 256, page: int = PAGE, asked: int = ASKED, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score), exact.

    Components become floor(scale * component). An anchor's positives are the `positives` other rows of its label of the
    largest inner products; of each, its negatives are the `negatives` rows of other labels of the largest products
    between `least` and `most` percent of the positive's. Ties go to the smaller id; a positive without such rows has none.

    Vectors get one more component that makes them equally long, so that the largest product is the smallest distance.
    They are stored by (nearest pivot, distance from it), cut into pages; an anchor scans the pages nearest to its own
    distance first and goes on until the triangle inequality rules the others out. Only the pages' bounds are broadcast, at most some
    65,536 of them: pages grow beyond that. Anchors travel in blocks of near ones. A label or a group of equal vectors
    of any size fills pages of its own.

    Rows with a null id, label or vector or a null or non-finite component take no part. Each row is one of its own, also where
    ids repeat. Shorter vectors are filled up with zeros, the empty one included. No rows, no result. Inner products beyond
    64 bits are an error.
    """
    v = F.col(vector)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.transform(v, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("x"), F.coalesce(anchors, F.lit(False)).alias("asks"),
    )
    store = Store(rows, page, asked)
    if not store.n:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    every = store.anchors.select("row", F.lit(0).cast("long").alias("w"), F.lit(-MOST).alias("lo"), F.lit(MOST).alias("hi"))
    near = store.search(every, True, positives).select("row", F.col("id").alias("positive_id"), F.col("score").alias("w"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    windows = near.select("row", "w").distinct().select("row", "w", F.ceil(wide("w") * least / 100).cast("long").alias("lo"), F.floor(wide("w") * most / 100).cast("long").alias("hi"))
    far = store.search(windows.where("lo <= hi"), False, negatives)
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("row", "w").orderBy(F.desc("score"), "id")))
    out = near.join(far, ["row", "w"]).join(store.anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("w").alias("positive_score"), F.col("score").alias("negative_score"))
