import random
import re

import numpy as np
import pytest
import xxhash
from tests.conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import queries, simhash
from tessella.operators import graph
from tests.llm.conftest import ODD

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain(text, width=4):
    w = WORD.findall((text or "").encode().translate(LOWER))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def closed(ids, fps, distance):
    f = np.array(fps, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(f ^ x) <= distance) for x in f]
    big = 1 << 62
    label = [big if i is None else i for i in ids]
    while True:
        new = [min(label[j] for j in n) for n in near]
        if new == label:
            return [None if v == big else v for v in label]
        label = new


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op1_simhash(spark, SF).collect()}
    fps = [plain(d.text) for d in docs]
    want = closed([d.doc_id for d in docs], fps, 4)
    assert len(got) == len(docs)
    for d, f, c in zip(docs, fps, want, strict=True):
        assert (got[d.doc_id].fingerprint, got[d.doc_id].component_id) == (f"{f:016x}", c)


def test_odd_rows(spark, make_docs):
    rows = ODD
    got = sorted(simhash.near_duplicates(make_docs(rows)).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fps = [plain(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], closed([r[0] for r in rows], fps, 4), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [tuple(r)[:3] for r in got] == want


def test_long_text_in_chunks():
    text = " ".join(f"w{i * i % 997}" for i in range(40_000))
    assert simhash.fingerprint(text.encode(), 4) == plain(text)


def test_empty_table(spark, make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert simhash.distinct_documents(make_docs([])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4, unique=True))
def test_every_close_pair_meets_in_a_table(x, flips):
    y = x ^ sum(1 << b for b in flips)
    assert any(x & m == y & m for m in simhash.masks(64, *simhash.SURE))


@pytest.mark.parametrize("most", [4096, 20])
def test_links_in_a_dense_bucket(spark, most):
    """A low bound deals the dense runs again, and connects the same."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(12)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), most=most)
    n = edges.distinct().count()
    got = {r.node: r.component for r in graph.components(edges, "a", "b").collect()}
    want = closed(signed, [f % 2**64 for f in signed], 4)
    groups = {}
    for f, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(got.get(f, f))
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)
    assert n < (35 if most > 300 else 300) * len(fps)


def test_components_of_chains_loops_and_repeats(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (501, 502), (7, 7), (900, 900)] * 2
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 500}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_one_document_of_each_group_stays(spark, make_docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 10)))
    rows, groups = [], []
    for g in range(30):
        base = [word() for _ in range(200)]
        ids = []
        for k in range(4):
            w = list(base)
            for _ in range(2 if k else 0):
                w[rng.randrange(200)] = word()
            ids.append(100 * g + k)
            rows.append((ids[-1], " ".join(w)))
        groups.append(ids)
    lone = [(10_000 + i, " ".join(word() for _ in range(rng.randrange(5, 300)))) for i in range(40)]
    rows += lone + [rows[0], (99_999, rows[4][1])]
    got = [r.doc_id for r in simhash.distinct_documents(make_docs(rows)).collect()]
    assert sorted(got) == sorted([g[0] for g in groups] + [i for i, _ in lone])


def test_distinct_documents_keep_columns_and_odd_rows(spark, make_docs):
    docs = make_docs(ODD)
    out = simhash.distinct_documents(docs)
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    assert len([t for t in texts if not (t or "").strip()]) == 1  # all without words are one group
    assert texts.count("same text of several words here") == 1 and len(texts) == len(set(texts))


def shingled(text, width=5):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def alike(x, y):
    return len(x & y) >= 0.8 * len(x | y)


def test_appended_and_cut_copies_leave_one(spark, make_docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 11)))
    rows = []
    for g in range(150):
        n = rng.choice((8, 20, 60, 300, 900))
        base = [word() for _ in range(n)]
        more = int((n - 4) * rng.uniform(0.2, 0.25))
        longer, shorter = base + [word() for _ in range(more)], base[more - n // 20 :]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(longer if g % 2 else shorter))]
    rows = [r for g in range(150) for r in rows[2 * g : 2 * g + 2] if alike(*(shingled(t) for _, t in rows[2 * g : 2 * g + 2]))]
    assert len(rows) > 200
    got = {r.doc_id for r in simhash.distinct_documents(make_docs(rows)).collect()}
    assert got == {i for i, _ in rows if i % 2 == 0}


@pytest.mark.parametrize("whole,cell", [(16_384, 512), (16_384, 16), (20, 16)])
def test_large_runs_keep_every_pair(spark, make_docs, whole, cell):
    """Texts of one family whose pairs lie on both sides of the similarity: closed by exact sets, in one block or many, by forests or leaders."""
    rng = random.Random(9)
    rows = []
    for f, n in enumerate((100, 240, 400)):
        base = [f"f{f}w{i}" for i in range(n)]
        for k in range(60):
            w = list(base)
            for i in rng.sample(range(n), n // 80 + rng.randrange(2)):
                w[i] = f"x{rng.randrange(10**6)}"
            rows.append((100 * f + k, " ".join(w)))
    sets = [shingled(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        new = [min(label[j] for j in range(len(rows)) if alike(sets[i], sets[j])) for i in range(len(rows))]
        if new == label:
            break
        label = new
    got = sorted(r.doc_id for r in simhash.distinct_documents(make_docs(rows), whole=whole, cell=cell).collect())
    assert got == sorted({rows[x][0] for x in label})
    assert 10 < len(got) < 170


def test_near_fingerprints_meet_without_a_shared_minimum(spark, make_docs, monkeypatch):
    """Pairs at 4 of 64 bits or fewer are found by blocks alone: no two texts here share a minimum's key."""
    rng = random.Random(12)
    wide = simhash._wide

    def unmet(text, width):
        n, bits, keys = wide(text, width)
        return n, bits, np.array([xxhash.xxh3_64_intdigest(text, k) for k in range(len(keys))], np.uint64).view(np.int64)

    rows = []
    for f, n in enumerate((70, 150, 400, 12)):
        base = [f"f{f}w{i}" for i in range(n)]
        for k in range(40):
            w = list(base)
            for i in rng.sample(range(n), 1 + k % 2):
                w[i] = f"x{rng.randrange(10**6)}"
            rows.append((100 * f + k, " ".join(w)))
    rows += [(1000 + g, " ".join(f"g{g // 2}w{i}" for i in range(300 + g % 2))) for g in range(60)]
    first = [int(wide(t.encode(), 5)[1].view(np.uint64)[0]) for _, t in rows]
    sets = [shingled(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if (first[i] ^ first[j]).bit_count() <= 4 and alike(sets[i], sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    while (new := [min(label[j] for j in n) for n in near]) != label:
        label = new
    monkeypatch.setattr(simhash, "_wide", unmet)
    got = sorted(r.doc_id for r in simhash.distinct_documents(make_docs(rows)).collect())
    assert got == sorted({rows[x][0] for x in label})
    assert len(got) < len(rows) - 60
