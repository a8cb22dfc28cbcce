import zlib
from collections import Counter, defaultdict

from tests.conftest import SF
from pyspark.sql import functions as F

from tessella.llm import mixing, queries, sharding
from tests.llm.conftest import ODD


def level(sizes, weights, share, ceiling):
    """Targets by dealing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target = share * sum(sizes.values()), dict.fromkeys(names, 0.0)
    for _ in range(1000):
        room = [s for s in names if target[s] < ceiling * sizes[s] - 1e-9]
        if left < 1e-9 or not room:
            break
        unit, left = left / sum(w[s] for s in room), 0.0
        for s in room:
            target[s] += unit * w[s]
            over = max(0.0, target[s] - ceiling * sizes[s])
            target[s] -= over
            left += over
    return target


def check_mix(rows, docs):
    sizes, most = defaultdict(int), Counter()
    for r in docs:
        n = len((r.text or "").encode().split())
        sizes[r.source] += n
        most[r.source] = max(most[r.source], n)
    want, taken = level(sizes, mixing.WEIGHTS, 1.5, 2.0), Counter()
    assert len(rows) == len(docs)
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.size == 0 or r.taken % r.size == 0
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(most[s], 1)


def test_mix_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    first = queries.op3_mixing(spark, SF).collect()
    check_mix(first, docs)
    again = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet").repartition(7)).select("doc_id", "taken").collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_odd_rows(spark, make_docs):
    rows = [(*r[:2], "en", s) for r in ODD for s in ("a", None, "Z")] + [(50, "three little words", "en", "a")] * 9
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    check_mix(got, docs.collect())
    copies = [r.copies for r in got if r.doc_id == 50]
    assert max(copies) - min(copies) <= 1  # repeated rows share evenly
    assert mixing.mix(make_docs([])).count() == 0


def test_mixed_documents_follow_the_copies(spark, make_docs):
    rows = [(i, f"some words of document {i} " * (i % 7 + 1), "en", f"s{i % 3}") for i in range(200)] + [(500, "equal rows", "en", "s0")] * 5
    docs = make_docs(rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_pivotal_keeps_expectations(spark):
    n = 3000
    items = spark.range(n).select(F.lit("s").alias("stratum"), F.col("id").alias("h"), (1 + F.col("id") % 9).cast("double").alias("mass"), F.when(F.col("id") % 2 == 0, 0.3).otherwise(0.8).alias("p"))
    up = {r.h: r.up for r in mixing.pivotal(items, fan=16).collect()}
    assert len(up) == n and set(up.values()) <= {0, 1}
    mass = sum((1 + i % 9) * up[i] for i in range(n))
    assert abs(mass - sum((1 + i % 9) * (0.3 if i % 2 == 0 else 0.8) for i in range(n))) <= 9
    assert abs(sum(up[i] for i in range(0, n, 2)) / (n / 2) - 0.3) < 0.05


def test_shard_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_sharding(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        assert r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "key"
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shard_odd_rows(spark, make_docs):
    rows = sharding.shard(make_docs(ODD), 16, rows_per_slice=1).collect()
    assert len(rows) == len(ODD)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 1} == {(1, 0)}
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.shard(make_docs([])).count() == 0


def test_tree_confines_movement(spark):
    tree = {0: {0: {0: 1.0, 1: 1.0}, 1: {2: 1.0, 3: 3.0}}, 1: {2: {4: 2.0}}}
    other = {0: {0: {0: 1.0, 1: 1.0}, 1: {2: 3.0, 3: 1.0}}, 1: {2: {4: 2.0}}}
    ids = spark.range(20_000)
    rows = ids.select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), other).alias("b"), sharding.place(F.col("id"), sharding.grown(tree)).alias("g")).collect()
    share = Counter(r.a for r in rows)
    assert all(abs(share[s] / 20_000 - w / 8) < 0.02 for s, w in {0: 1, 1: 1, 2: 1, 3: 3, 4: 2}.items())
    assert all(r.a == r.b or {r.a, r.b} <= {2, 3} for r in rows)  # only the rack whose weights changed
    assert all(r.g in (r.a, 5) for r in rows)
