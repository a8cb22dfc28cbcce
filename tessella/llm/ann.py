"""Approximate nearest neighbours by cross-polytope hashing with fast Hadamard pseudo-rotations and multiprobe."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import batches_of, stash

TABLES, SEED = 12, 5
OCCUPANCY = 3  # vectors in a bucket, on average: the number of buckets follows the number of vectors
PROBED, GROWTH = 2.9, 0.37  # a query probes PROBED * vectors ** GROWTH buckets of each table
BEST = 64  # axes of one hash that probes are combined from
ROWS, QUERIES, PAIRS = 1 << 14, 1 << 16, 2_000_000  # vectors, queries and pairs that one task reranks, on average


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Walsh-Hadamard matrix, in n log n steps; their width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform; each table has its own signs."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rng = np.random.default_rng([SEED, table, width])
    for _ in range(3):
        x = hadamard(x * rng.choice((-1.0, 1.0), width)) / math.sqrt(width)
    return x


def plan(n: int, width: int) -> list[int]:
    """Axes that each of a table's hashes tells apart: all but the last one whole, so that n vectors fill about n / OCCUPANCY buckets."""
    whole, out, wanted = 1 << max(0, width - 1).bit_length(), [], max(2.0, n / OCCUPANCY)
    while wanted > 2 * whole:
        out.append(whole)
        wanted /= 2 * whole
    return [*out, min(whole, max(1, math.ceil(wanted / 2)))] if wanted > 1.5 or not out else out


def probes_of(n: int) -> int:
    """Buckets that a query probes in each table of n vectors."""
    return max(12, math.ceil(PROBED * n**GROWTH))


def buckets(x: np.ndarray, table: int, axes: list[int], probes: int = 1) -> np.ndarray:
    """Of each unit row its `probes` nearest buckets, nearest first.

    A bucket is one signed axis for each hash. Its distance is the sum over hashes of how far the axis falls behind the
    nearest one, squared; a hash offers its BEST axes.
    """
    cost, key = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for k, n in enumerate(axes):
        y = rotated(x, table * 16 + k)[:, :n]
        both = np.concatenate((y, -y), axis=1)
        m = min(BEST if probes > 1 else 1, 2 * n)
        top = np.argsort(-both, axis=1, kind="stable")[:, :m]
        near = np.take_along_axis(both, top, axis=1)
        cost = (cost[:, :, None] + ((near[:, :1] - near) ** 2)[:, None, :]).reshape(len(x), -1)
        key = (key[:, :, None] * (2 * n) + top[:, None, :]).reshape(len(x), -1)
        keep = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        cost, key = np.take_along_axis(cost, keep, axis=1), np.take_along_axis(key, keep, axis=1)
    return key


def usable(vector: str) -> F.Column:
    """Not null, not zero, all components finite."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _hashed(axes: list[int], probes: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, None, 128 if probes > 1 else 2048):
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for t in range(tables):
                a = buckets(x, t, axes, probes)
                rows = pa.array(np.repeat(np.arange(len(x)), a.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(a.size, t, np.int32)), pa.array(a.ravel()), batch.column(0).take(rows)], ["t", "key", "id"])

    return run


def _best(k: int, every: bool):
    def run(key: tuple, pairs: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        """Of each query of a cell the k best rows, by the exact distance; pairs (q, r), or all of them."""
        asked = vectors["asks"].to_numpy(bool)
        (q, xq), (r, xr) = ((vectors["id"].to_numpy()[m], vectors["v"].to_numpy()[m]) for m in (asked, ~asked))
        none = pd.DataFrame({"q": np.empty(0, np.int64), "r": np.empty(0, np.int64), "score": np.empty(0)})
        if not (len(q) and len(r)):
            return none
        order_q, order_r = np.argsort(q), np.argsort(r)
        q, r, xq, xr = q[order_q], r[order_r], np.stack(xq)[order_q].astype(np.float64), np.stack(xr)[order_r].astype(np.float64)
        out = []

        def ranked(i: np.ndarray, j: np.ndarray) -> None:
            d = np.empty(len(i))
            for at in range(0, len(i), 1 << 14):
                gap = xq[i[at : at + (1 << 14)]] - xr[j[at : at + (1 << 14)]]
                d[at : at + (1 << 14)] = np.sqrt((gap * gap).sum(axis=1))
            order = np.lexsort((r[j], d, i))
            i, j, d = i[order], j[order], d[order]
            first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
            keep = place < k
            out.append(pd.DataFrame({"q": q[i[keep]], "r": r[j[keep]], "score": d[keep]}))

        if every:
            for i in range(len(q)):
                ranked(np.full(len(r), i), np.arange(len(r)))
        elif len(pairs):
            ranked(np.searchsorted(q, pairs["q"].to_numpy()), np.searchsorted(r, pairs["r"].to_numpy()))
        return pd.concat(out) if out else none

    return run


def _reranked(pairs: DataFrame | None, asked: DataFrame, rows: DataFrame, k: int, n_asked: int, n_rows: int, n_pairs: int) -> DataFrame:
    """(q, r, score): of each asked vector the k best of its pairs, or of all rows.

    Queries and rows are cut into blocks by hash; a cell holds one block of each and the pairs between them, so a vector
    travels once for each block of the other side and no pair carries a vector.
    """
    across = max(1, math.ceil(n_asked / QUERIES))
    down = max(1, math.ceil(n_rows / ROWS), math.ceil(n_pairs / (across * PAIRS)))
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(cell("id", across).alias("a"), every(down).alias("b"), "id", "v", F.lit(True).alias("asks"))
    right = rows.select(every(across).alias("a"), cell("id", down).alias("b"), "id", "v", F.lit(False).alias("asks"))
    vectors = left.unionByName(right)
    if pairs is None:
        cells = vectors.select("a", "b").distinct().withColumns({"q": F.lit(0).cast("long"), "r": F.lit(0).cast("long")})
    else:
        cells = pairs.select(cell("q", across).alias("a"), cell("r", down).alias("b"), "q", "r")
    found = cells.groupBy("a", "b").cogroup(vectors.groupBy("a", "b")).applyInPandas(_best(k, pairs is None), "q long, r long, score double")
    return _top(found, "q", "r", k)


def _top(found: DataFrame, q: str, r: str, k: int) -> DataFrame:
    return found.withColumn("place_", F.row_number().over(Window.partitionBy(q).orderBy("score", r))).where(F.col("place_") <= k).drop("place_")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): of each query's vector the k nearest rows found, but for its own id.

    score is the Euclidean distance in double precision; nearest first, ties to the smaller id. Vectors that are null,
    zero, empty or hold a null or non-finite component take no part, on either side, nor do those whose length isn't the
    commonest one of the rows (of equally common ones the greater). Each row is one of its own, also where ids repeat: a
    query leaves out just one row of its id and vector. A query that finds fewer than k rows is compared with all rows, in blocks.

    Equal vectors are one: it stands for its k + 1 smallest ids, which are all that any answer can hold. Every vector is
    in one bucket of each table; the number of buckets follows the number of vectors, and a query probes about its
    0.37th power of them, nearest first, so it meets a share of the vectors that falls as they grow. Only ids meet in the tables;
    vectors are joined once, to rerank the distinct pairs.
    """
    cols = lambda df: df.where(usable(vector)).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null")
    rows, asked = stash(cols(vectors)), stash(cols(queries).withColumn("row", F.monotonically_increasing_id()))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = common[0] if common else 1
    rows, asked = (df.where(F.size("v") == width) for df in (rows, asked))
    few = rows.withColumn("i", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("i") <= k + 1)
    named = lambda df: stash(df.repartitionByRange("least", "v").sortWithinPartitions("least", "v").withColumn("id", F.monotonically_increasing_id()).drop("least"))  # noqa: E731  in the order of the least ids
    classes = named(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("least", F.element_at("ids", 1)))
    askers = named(asked.groupBy("v").agg(F.min("id").alias("least")))
    of = stash(asked.join(askers.withColumnRenamed("id", "q"), "v").select("row", F.col("id").alias("query_id"), "q"))
    n, m = classes.count(), askers.count()
    axes, probes = plan(n, width), probes_of(n)
    hashed = "t int, key long, id long"
    index = classes.select("id", "v").mapInArrow(_hashed(axes, 1, tables), hashed).select("t", "key", F.col("id").alias("r"))
    probe = askers.select("id", "v").mapInArrow(_hashed(axes, probes, tables), hashed).select("t", "key", F.col("id").alias("q"))
    pairs = stash(index.hint("merge").join(probe, ["t", "key"]).select("q", "r").distinct())  # a few queries make many probes: never broadcast them

    def answers(best: DataFrame) -> DataFrame:
        """(row, query_id, rank, vec_id, score): the ids behind the vectors, but for one row that equals the query's."""
        ids = best.join(classes.select(F.col("id").alias("r"), "ids"), "r").select("q", "score", F.explode("ids").alias("vec_id"))
        met = of.join(_top(ids, "q", "vec_id", k + 1), "q").withColumn("own", (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0))
        met = met.withColumn("nth", F.row_number().over(Window.partitionBy("row", "own").orderBy("score", "vec_id"))).where(~F.col("own") | (F.col("nth") > 1))
        return met.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))).where(F.col("rank") <= k).select("row", "query_id", "rank", "vec_id", "score")

    out = stash(answers(_reranked(pairs, askers, classes.select("id", "v"), k + 1, m, n, pairs.count())))
    short = of.join(out.groupBy("row").agg(F.count("*").alias("n")), "row", "left").where(F.coalesce("n", F.lit(0)) < k).select("q").distinct()
    short = stash(askers.join(short, askers["id"] == short["q"], "left_semi"))
    if left := short.count():  # compared with all rows: exact
        more = answers(_reranked(None, short, classes.select("id", "v"), k + 1, left, n, left * n))
        again = of.join(short.select(F.col("id").alias("q")), "q", "left_semi").select("row")
        out = out.join(again, "row", "left_anti").unionByName(more.join(again, "row", "left_semi"))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
