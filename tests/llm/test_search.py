import math
import random

import numpy as np
import pytest
from tests.conftest import SF
from pyspark.sql import functions as F

from tessella.llm import ann, decontam, queries
from tests.llm.conftest import ODD


def nearest(rows, asked, k):
    out = {}
    for q in asked:
        a = np.array(rows[q])
        near = sorted((math.sqrt(((a - np.array(v)) ** 2).sum()), i) for i, v in rows.items() if i != q)[:k]
        out[q] = [(i, d) for d, i in near]
    return out


def test_nearest_query_recall(spark):
    rows = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    asked = [i for i in rows if i % 100 == 0]
    want, got = nearest(rows, asked, 10), {}
    for r in queries.op9_nearest(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in asked:
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11))
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        a = np.array(rows[q])
        assert all(abs(s - math.sqrt(((a - np.array(rows[v])) ** 2).sum())) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 10 * len(asked)


def test_recall_holds_and_the_share_of_rows_met_falls():
    """The tables alone, at three sizes: at least 0.9 of the ten nearest are met, by an ever smaller share of all rows."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(10, 64))
    shares = []
    for n in (500, 5_000, 30_000):
        x = centres[rng.integers(0, 10, n)] + rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q = np.arange(60)
        axes, probes = ann.plan(n, 64), ann.probes_of(n)
        met = np.zeros((len(q), n), bool)
        for t in range(ann.TABLES):
            own, asked = ann.buckets(x, t, axes)[:, 0], ann.buckets(x[q], t, axes, probes)
            for i in q:
                met[i] |= np.isin(own, asked[i])
        far = ((x[q, None, :] - x[None]) ** 2).sum(axis=2) if n <= 5_000 else np.stack([((x - x[i]) ** 2).sum(axis=1) for i in q])
        far[q, q] = np.inf
        true = np.argsort(far, axis=1)[:, :10]
        assert np.take_along_axis(met, true, axis=1).mean() >= 0.9
        shares.append(met.mean())
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.35


def test_copies_of_a_vector_are_one(spark):
    rng = random.Random(2)
    rows = {i: [1.0] + [0.0] * 7 for i in range(300)} | {1000 + i: [rng.gauss(0, 1) for _ in range(8)] for i in range(100)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id in (0, 5, 299, 1000)"), k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (0, 5, 299):
        assert sorted(got[q]) == [(k + 1, v, 0.0) for k, v in enumerate([i for i in range(9) if i != q][:7])]
    assert len(got[1000]) == 7


def test_rows_of_a_repeated_id_are_rows(spark):
    """Every row but the query's own is a candidate, also of the query's id."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 2.0]), (3, [1.0, 1.0]), (100, [1.0, 0.5]), (100, [1.0, 0.5]), (100, [3.0, 0.0]), (100, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id = 100"), k=4).collect()
    want = []
    for i, (q, a) in enumerate(rows):
        if q == 100:
            near = sorted((math.dist(a, b), j) for m, (j, b) in enumerate(rows) if m != i)[:4]
            want += [(q, n + 1, j, d) for n, (d, j) in enumerate(near)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_vectors_of_another_length_take_no_part(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 2.0, 1.0]) for i in range(20)] + [(50, [1.0, 2.0]), (51, [1.0] * 4)], "vec_id long, embedding array<double>")
    got = ann.search(df, df, k=3).collect()
    assert {r.query_id for r in got} == set(range(20)) and {r.vec_id for r in got} <= set(range(20))


def test_nearest_odd_rows(spark):
    bad = [(1, None), (2, []), (3, [0.0] * 8), (4, [float("nan")] + [1.0] * 7), (5, [float("inf")] + [1.0] * 7), (6, [None] + [1.0] * 7), (None, [1.0] * 8)]
    rng = random.Random(1)
    good = {100 + i: [rng.gauss(0, 1) for _ in range(8)] for i in range(6)}
    good |= {200: [1.0] * 8, 201: [1.0] * 8, 202: [2.0] * 8}
    df = spark.createDataFrame([*bad, *good.items(), (200, [1.0] * 8)], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("t", "axis", "id", "v", "slices")})
    rows, want = [*good.items(), (200, [1.0] * 8)], []
    for i, (q, a) in enumerate(rows):  # fewer candidates than k: all of them
        near = sorted((math.dist(a, b), j) for m, (j, b) in enumerate(rows) if m != i)
        want += [(q, n + 1, j) for n, (_, j) in enumerate(near)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, df, k=10).collect()) == sorted(want)
    assert ann.search(df.limit(0), df.limit(0)).collect() == []


def test_cells_of_any_size_give_the_same(spark, monkeypatch):
    df = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") / 1e3).cast("double")).alias("embedding"))
    for rows, asked, pairs in ((1 << 14, 1 << 16, 1 << 20), (9, 2, 50)):
        for k, v in (("ROWS", rows), ("QUERIES", asked), ("PAIRS", pairs)):
            monkeypatch.setattr(ann, k, v)
        got = ann.search(df, df.where("vec_id in (0, 50, 51, 52)"), k=4).where("query_id = 50").orderBy("rank").collect()
        assert {r.vec_id for r in got} == {48, 49, 51, 52}


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(0).normal(size=(5, 24))
    y = ann.rotated(x, 3)
    assert y.shape == (5, 32) and np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1))


def test_decontamination_query_finds_whole_items(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    flat = lambda t: " ".join(t.lower().split())
    want = {(d.doc_id, i.item_id) for d in docs for i in items if flat(i.text) in flat(d.text)}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, SF).collect()}
    assert want <= got and len(got) <= len(want) + 2


def brute_above(index, terms):
    """Every part's score for a passage's terms, without pruning."""
    score = {}
    for t in terms:
        for k in range(index.start[t], index.start[t + 1]):
            score[index.part[k]] = score.get(index.part[k], 0.0) + index.impact[k]
    return {p: s for p, s in score.items() if s >= decontam.THETA - 1e-9}


def test_pruning_loses_nothing():
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(60)]
    index = decontam.Index([(i, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 40)))) for i in range(70)])
    passages = [sorted(set(rng.sample(range(len(index.terms)), rng.randrange(1, 45)))) for _ in range(200)]
    owner = np.concatenate([np.full(len(p), i) for i, p in enumerate(passages)])
    possible = set(index.possible(owner, np.concatenate(passages), len(passages)).tolist())
    hits = 0
    for i, p in enumerate(passages):
        want, got = brute_above(index, p), dict(index.above(p))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert not want or i in possible
        hits += len(want)
    assert hits > 20 and len(possible) < len(passages)


def test_the_best_passage_counts(spark, make_docs):
    item = " ".join(f"word{i}" for i in range(60))
    damaged = item.replace("word30", "other").replace("word55", "more")
    filler = " ".join(f"f{i}" for i in range(900))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    row = decontam.leaks(make_docs([(1, f"{damaged} {filler} {item} {filler}")]), bench).first()
    assert row.score > 0.999 and row.overlap == 1.0


def test_scores_do_not_depend_on_the_number_of_indexes(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [sorted((r.doc_id, r.item_id, round(r.score, 9), r.overlap) for r in decontam.leaks(docs, bench, most=m).collect()) for m in (1 << 23, 9_000)]
    assert rows[0] == rows[1] and rows[0]
    assert len(decontam._indexes(bench, most=9_000)[0]) > 1


@pytest.mark.parametrize("most", [1 << 23, 600])
def test_decontamination_odd_rows(spark, make_docs, most):
    question = "which river runs through the old town of many bridges and narrow lanes."
    items = [(1, f"{question} the Vltava"), (2, None), (3, ""), (4, "short one"), (4, "short one"), (5, " ".join(f"t{i}" for i in range(400))), (None, "an item without any id at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(3000))
    rows = [*ODD, (70, f"{filler} WHICH river, runs through the old town of many bridges and narrow lanes! The Vltava {filler}"), (71, f"{filler} which river runs somewhere else {filler}"),
            (72, f"a {items[5][1]} b"), (73, "well short one it was"), (74, "an item without any id at all"), (74, "an item without any id at all")]
    got = sorted((r.doc_id, r.item_id) for r in decontam.leaks(make_docs(rows), bench, most=most).where("item_id is not null").collect())
    assert got == [(70, 1), (72, 5), (73, 4)]
    assert decontam.leaks(make_docs(rows), bench, most=most).where("item_id is null").count() == 2
    docs = make_docs(rows)
    kept = decontam.clean(docs, bench, most)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 5
    assert decontam.leaks(make_docs([]), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_clean_judges_rows_not_ids(spark, make_docs):
    item = "which river runs through the old town of the northern province then"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = ["a clean text of some words about nothing in particular", "another clean text that shares no passage with any item"]
    rows = [(None, item), (None, texts[0]), (None, None), (7, item), (7, texts[1]), (7, texts[1])]
    kept = decontam.clean(make_docs(rows), bench).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, texts[0]), (7, texts[1]), (7, texts[1])]
