import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tessella.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, row int, x string, w int, page int, pivot int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA).repartition(3)


def plain(rows, every, p=5, n=5, least=80, most=100, scale=256):
    rows = [(i, [math.floor(scale * float(np.float32(e))) for e in v], t) for i, v, t in rows if i is not None and v is not None and t is not None and all(e is not None and math.isfinite(e) for e in v)]
    out = []
    for k, (i, x, t) in enumerate(rows):
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), j, u == t) for m, (j, y, u) in enumerate(rows) if m != k))
        for s, j, _ in [c for c in scored if c[2]][:p]:
            fits = [c for c in scored if not c[2] and least * -s <= 100 * -c[0] <= most * -s]
            out += [(i, j, r + 1, c[1], -s, -c[0]) for r, c in enumerate(fits[:n])]
    return Counter(out)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op12_hard_negatives"])
    got = queries.op12_hard_negatives(spark, SF).select(*want.columns).collect()
    assert got and Counter(map(tuple, got)) == Counter(want.fetchall())


@pytest.mark.parametrize("page,asked", [(4, 3), (64, 8), (1024, 256)])
def test_equals_brute_force(spark, page, asked):
    """Clusters, many equal vectors (a third of all), ties, repeated ids, ragged and odd vectors."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist(), int(rng.integers(0, 4))) for i in range(160)]
    rows += [(200 + i, [0.5] * 8, i % 3) for i in range(90)]
    rows += [(10, [0.25] * 8, 1), (10, [0.1] * 8, 2), (10, [0.1] * 8, 2), (20, [1.0, 2.0], 1), (30, [], 2), (40, [0.0] * 8, 1)]
    rows += [(None, [1.0] * 8, 1), (50, None, 1), (60, [1.0] * 8, None), (70, [float("nan")] * 8, 1), (80, [None, 1.0], 1), (90, [float("inf")] * 8, 2)]
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, page=page, asked=asked)
    assert Counter(map(tuple, got.collect())) == plain(rows, 10)


def test_few_rows(spark):
    none = frame(spark, [(1, [1.0], 1)]).limit(0)
    assert negatives.mine(none, F.lit(True)).collect() == []
    for rows in ([(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)], [(0, [1.0], 1), (1, [1.0], 1), (2, [-1.0], 2), (3, [0.9], 2)], [(0, [0.0], 1), (0, [0.0], 1), (0, [0.0], 2)]):
        assert Counter(map(tuple, negatives.mine(frame(spark, rows), F.lit(True)).collect())) == plain(rows, 1)


def test_windows_and_counts_are_parameters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5).tolist(), i % 2) for i in range(80)]
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 7 == 0, positives=3, negatives=2, least=50, most=90, scale=100, page=8)
    assert Counter(map(tuple, got.collect())) == plain(rows, 7, 3, 2, 50, 90, 100)


def test_large_components(spark):
    """Sums that doubles don't hold are exact; those beyond 64 bits are an error."""
    rows = [(i, [float(2**17 + i), float(2**18 - 3 * i)], i % 2) for i in range(9)]
    assert Counter(map(tuple, negatives.mine(frame(spark, rows), F.lit(True)).collect())) == plain(rows, 1)
    with pytest.raises(ValueError):
        negatives.mine(frame(spark, [(1, [1e30], 1)]), F.lit(True))


def test_pages_are_sorted_intervals(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, i, i % 3, rng.integers(-50, 50, 4).tolist(), i % 9 == 0) for i in range(9000)], "row long, id long, label long, x array<long>, asks boolean")
    store = negatives.Store(rows, 100, 16)
    pages = store.pages.select("pivot", "low", "high", "n").collect()
    assert sum(p.n for p in pages) == 9000 and max(p.n for p in pages) <= 100 and len({p.pivot for p in pages}) == 2
    spans = sorted((p.pivot, p.low, p.high) for p in pages)
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:]))


def test_far_pages_are_never_scanned(spark):
    """Two clusters far apart: the triangle inequality rules the other one out."""
    rng = np.random.default_rng(8)
    x = np.concatenate((rng.normal(size=(5000, 4)) + 300, rng.normal(size=(5000, 4)) - 300)).astype(int)
    rows = spark.createDataFrame([(i, i, 0, v, i < 40) for i, v in enumerate(x.tolist())], "row long, id long, label long, x array<long>, asks boolean")
    store = negatives.Store(rows, 200, 16)
    needed = negatives._needed(store.width, store.longest, store.pivots, store.directory, negatives.START, 1 << 30)
    state = store.where.select("page", F.struct("row", F.lit(0).cast("long").alias("w"), F.lit(-negatives.MOST).alias("lo"), F.lit(negatives.MOST).alias("hi"), F.lit(0).cast("long").alias("floor")).alias("s")).groupBy("page").agg(F.collect_list("s").alias("state"))
    far = store.blocks.join(state, "page").mapInArrow(needed, "ask long, to long, who binary").select("to").distinct()
    assert far.count() <= store.count / 2
