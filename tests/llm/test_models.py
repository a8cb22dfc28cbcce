import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tests.conftest import SF
from pyspark.sql import functions as F

from tessella.llm import langid, lm, queries, toxicity
from tests.llm.conftest import ODD

SF2 = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_language_query_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    got = queries.op7_language_id(spark, SF2).collect()
    assert len(got) == len(rows) and all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) > 0.97 * len(held)


def test_language_of_odd_rows(spark, make_docs):
    train = make_docs([(i, "the quick brown fox", "en") for i in range(5)] + [(9 + i, "der schnelle braune fuchs", "de") for i in range(5)] + [(20, None, "fr"), (21, "x", None)])
    model = langid.fit(train)
    assert model.langs == ["de", "en"]
    rows = [*ODD, (60, "12 !! 34"), (61, "The QUICK, fox!"), (62, "schnell braun"), (63, "☃")]
    got = {r.doc_id: r for r in langid.predict(make_docs(rows), model).collect()}
    assert len(langid.predict(make_docs(rows), model).collect()) == len(rows)
    assert [got[i].lang_pred for i in (1, 2, 3, 60, 63)] == ["und"] * 5 and got[60].score == 0
    assert (got[61].lang_pred, got[62].lang_pred) == ("en", "de")
    assert langid.predict(make_docs([]), model).count() == 0
    none = langid.fit(make_docs([]))
    assert {r.lang_pred for r in langid.predict(make_docs(ODD), none).collect()} == {"und"}


def chained(model_counts, word, lang):
    """A word's log probability after another way: character by character, the longest known context first."""
    padded, total = f"^{word}$", 0.0
    singles = {i: c for n, i, g, c in model_counts if n == 1 and g == lang}
    every = {i for n, i, _, _ in model_counts if n == 1}
    for i in range(1, len(padded)):
        for step, n in enumerate(range(min(5, i + 1), 0, -1)):
            gram = padded[i - n + 1 : i + 1]
            c = sum(k for m, x, g, k in model_counts if (m, x, g) == (n, gram, lang))
            if n == 1:
                total += step * math.log(0.4) + math.log((c + 0.1) / (sum(singles.values()) + 0.1 * (len(every) + 1)))
            elif c:
                before = sum(k for m, x, g, k in model_counts if (m, x, g) == (n - 1, gram[:-1], lang))
                total += step * math.log(0.4) + math.log(c / before)
                break
    return total


def test_unseen_words_against_plain_loops():
    counts = Counter()
    for lang, words in (("a", ["known", "knowing", "owning"]), ("b", ["zunge", "jung", "ung"])):
        for w in words:
            counts[0, w, lang] += 2
            for n in range(1, 6):
                for g in langid.grams(w, n):
                    counts[n, g, lang] += 2
    counts = [(*k, c) for k, c in counts.items()]
    model = langid.Model(["a", "b"], counts)
    words = ["known", "unknown", "zung", "q", "", "xyz", "owningung", "w" * 300]
    logs, told = model.likelihoods(words)
    assert told.tolist() == [True, True, True, True, False, True, True, True] and (logs[4] == 0).all()
    assert logs[0, 0] > logs[0, 1] and logs[2, 1] > logs[2, 0]
    for w, row in zip(words, logs, strict=True):
        if w and w != "known":
            assert np.allclose(row, [chained(counts, w, x) for x in "ab"], rtol=1e-4), w


def test_language_score_is_a_share_of_words(spark, make_docs):
    model = langid.fit(make_docs([(i, "the quick brown fox jumps over", "en") for i in range(5)] + [(9 + i, "der schnelle braune fuchs springt weit", "de") for i in range(5)]))
    one, two = "the quick brown fox jumps over", "der schnelle braune fuchs springt weit"
    got = {r.doc_id: r for r in langid.predict(make_docs([(1, f"{one} " * 500), (2, f"{one} {two} " * 500), (3, one)]), model).collect()}
    assert abs(got[1].score - got[3].score) < 1e-6 and got[1].score > 0.9 and abs(got[2].score - 0.5) < 0.1


def test_toxicity_query_on_held_out_documents(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    hits = sum(r.predicted and toxic[r.doc_id] for r in held)
    assert hits > 0.85 * sum(toxic[r.doc_id] for r in held) and hits > 0.8 * sum(r.predicted for r in held)


def test_toxicity_odd_rows(spark, make_docs):
    docs = make_docs(ODD + [(100 + i, f"filler words {i} idiot" if i % 3 == 0 else f"filler words {i}") for i in range(120)])
    labels = spark.createDataFrame([(100 + i, int(i % 3 == 0)) for i in range(120)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ODD) + 120 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int((r.doc_id - 100) % 3 == 0) for r in got if (r.doc_id or 0) >= 100)
    blank = toxicity.fit(make_docs([]), labels.limit(0))
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.5}
    assert toxicity.score(make_docs([]), model).count() == 0


def test_nnpu_finds_hidden_positives():
    rng = np.random.default_rng(0)
    pos = [[0] + sorted(set(rng.integers(2, 30, 5).tolist())) for _ in range(300)]
    hidden = [[0] + sorted(set(rng.integers(2, 30, 5).tolist())) for _ in range(200)]
    neg = [[1] + sorted(set(rng.integers(2, 30, 5).tolist())) for _ in range(800)]
    p = np.array([True] * 300 + [False] * 1000)
    w, b = toxicity.nnpu(pos + hidden + neg, p, np.ones(30), 0.2)
    z = np.array([b + w[x].sum() for x in pos + hidden + neg])
    at = toxicity.cut(z, p, 0.2)
    assert (z[300:500] > at).mean() > 0.95 and (z[500:] < at).mean() > 0.95


def plain_risk(z, positive, prior):
    loss = lambda v, y: math.log1p(math.exp(-v * y))
    p, u = [v for v, q in zip(z, positive, strict=True) if q], [v for v, q in zip(z, positive, strict=True) if not q]
    negative = sum(loss(v, -1) for v in u) / len(u) - prior * sum(loss(v, -1) for v in p) / len(p)
    return prior * sum(loss(v, 1) for v in p) / len(p) + max(0.0, negative), negative


def test_risk_against_plain_loops():
    rng = np.random.default_rng(3)
    for shift in (0.0, -3.0):
        z, p = rng.normal(shift, 1, 40), np.arange(40) < 15
        if shift:
            z[p] += 6
        for prior in (0.2, 0.7):
            value, step = toxicity.risk(z, p, prior)
            want, negative = plain_risk(z, p, prior)
            assert abs(value - want) < 1e-9
            for i in (0, 20):
                up, down = z.copy(), z.copy()
                up[i] += 1e-5
                down[i] -= 1e-5
                k = 0 if negative >= 0 else 1
                slope = (plain_risk(up, p, prior)[k] - plain_risk(down, p, prior)[k]) / 2e-5
                assert abs(step[i] - (slope if negative >= 0 else -slope)) < 1e-6


def test_cut_is_the_least_estimated_error():
    rng = np.random.default_rng(4)
    z = np.concatenate((rng.normal(2, 1, 100), rng.normal(2, 1, 60), rng.normal(-2, 1, 240)))
    p = np.arange(400) < 100
    at = toxicity.cut(z, p, 0.2)

    def error(c):
        up, uu = sum(v <= c for v in z[p]) / 100, sum(v > c for v in z[~p]) / 300
        return 0.2 * up + max(0.0, uu - 0.2 * (1 - up))

    assert all(error(at) <= error(c) + 1e-9 for c in [*z, *(z + 1e-6), *np.linspace(-6, 6, 200)]) and -1.5 < at < 1.5


def base_scores(rows, learns):
    toks = [(r[1] or "").encode().lower().split() + [b""] for r in rows]
    c = Counter(w for r, t in zip(rows, toks, strict=True) if learns(r) for w in t)
    n, v = sum(c.values()), len(c)
    return [(r[0], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for r, t in zip(rows, toks, strict=True)]


def test_lm_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {r[0]: r for r in base_scores(rows, lambda r: crc(r[0]) % 5 != 1)}
    got = queries.op5_lm_score(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (*w[1:4], crc(r.doc_id) % 5 == 1)
        assert abs(r.base_score - w[4]) < 1e-6 and r.score < 0
    train = [r for r in got if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)


def test_lm_odd_rows(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 8)  # most words go by the join
    docs = make_docs(ODD)
    model, counts = lm.fit(docs.where("doc_id is not null"), F.col("doc_id"), rounds=2)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score(docs, model, counts).collect())
    want = sorted((r[0] is None, r[0] or 0, *r[1:4], round(r[4], 6)) for r in base_scores(ODD, lambda r: r[0] is not None))
    assert got == want
    model, counts = lm.fit(make_docs([]), F.col("doc_id"))
    rows = lm.score(docs, model, counts).collect()
    assert len(rows) == len(ODD) and all(r.n_known == 0 and abs(r.base_score) < 1e-9 for r in rows)
    assert lm.score(make_docs([]), model, counts).count() == 0


def spelled_out(model, texts):
    """Scores after another way: one token at a time, features and sums in plain loops."""
    top, out = model.words.to_pylist(), []
    rank = {w: i for i, w in enumerate(top)}
    row = lambda key, rows: int(lm._hash(np.array([key]))[0] % rows)
    for text in texts:
        t = (text or "").encode().lower().split() + [b""]
        symbols = [rank[w] if rank.get(w, lm.COMMON) < lm.COMMON else lm.COMMON + lm.rare_class(w) for w in t]
        total = 0.0
        for i, (w, s) in enumerate(zip(t, symbols, strict=True)):
            one, two = (symbols[i - k] if i >= k else lm.CONTEXTS - 1 for k in (1, 2))
            cls = s // lm.WITHIN if s < lm.COMMON else s - lm.COMMON + lm.FREQUENT
            rows = [one, lm.CONTEXTS + two, 2 * lm.CONTEXTS + row(one * lm.CONTEXTS + two, lm.ROWS_1 - 2 * lm.CONTEXTS)]
            x = model.offset_1.astype(float) + sum(model.w1[r].astype(float) for r in rows)
            total += x[cls] - math.log(np.exp(x).sum())
            if s < lm.COMMON:
                z = model.offset_2[cls].astype(float) + sum(model.w2[row((k * lm.CONTEXTS + c) * lm.FREQUENT + cls, lm.ROWS_2)].astype(float) for k, c in enumerate((one, two)))
                total += z[s % lm.WITHIN] - math.log(np.exp(z).sum())
            else:
                total += math.log(((model.counts[rank[w]] if w in rank else 0) + 0.5) / model.rare_mass[s - lm.COMMON])
        out.append(total / math.log(10))
    return out


def test_lm_scores_against_plain_loops(spark, make_docs):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ODD[:10]
    model, counts = lm.fit(make_docs(rows), F.col("doc_id"), rounds=2)
    got = sorted((r.n_tokens, r.score) for r in lm.score(make_docs(rows), model, counts).collect())
    want = sorted(zip([len((r[1] or "").encode().split()) + 1 for r in rows], spelled_out(model, [r[1] for r in rows]), strict=True))
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-4, abs_tol=1e-3) for a, b in zip(got, want, strict=True))


def test_lm_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (dict(lm.score(d, *lm.fit(d, F.col("doc_id"))).select("doc_id", "score").collect()) for d in (docs.repartition(1), docs.repartition(8)))
    assert all(math.isclose(one[i], many[i], rel_tol=1e-4, abs_tol=1e-3) for i in one)


def test_lm_takes_the_most_frequent_words(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), 1 + i // 7) for i in range(500)] + [(f"t{i}".encode(), 200) for i in range(40)], "word binary, c long")
    for most in (5, 30, 100, 400, 2000):
        got = sorted((r.c for r in lm.most_frequent(counts, most).collect()), reverse=True)
        every = sorted([1 + i // 7 for i in range(500)] + [200] * 40, reverse=True)
        assert got == every[: len(got)] or most < 40
        assert abs(len(got) - min(most, 540)) <= max(8, most // 2)


def test_lm_probabilities_sum_to_one():
    rng = random.Random(1)
    words = [f"w{i}".encode() for i in range(3000)]
    counts = {w: rng.randrange(1, 50) for w in words} | {lm.END: 70}
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    rare = {}
    for w, c in counts.items():
        n, v = rare.get(lm.rare_class(w), (0, 0))
        rare[lm.rare_class(w)] = (n + c, v + 1)
    model = lm.Model(sum(counts.values()), len(counts), top, rare)
    gen = np.random.default_rng(2)
    model.w1[:] = gen.normal(0, 0.3, model.w1.shape)
    model.w2[:] = gen.normal(0, 0.3, model.w2.shape)
    context, rank = [3, lm.COMMON + 6, 7], {w: i for i, (w, _) in enumerate(top)}
    total = 0.0
    for w in counts:
        r = rank[w]
        s = r if r < lm.COMMON else lm.COMMON + lm.rare_class(w)
        places = model.places(np.array([*context, s]), np.array([4]))
        p = math.exp(model.log_p(*places)[-1])
        total += p if r < lm.COMMON else p * (counts[w] + 0.5) / model.rare_mass[lm.rare_class(w)]
    for k in range(lm.RARE):  # one unseen word a class
        places = model.places(np.array([*context, lm.COMMON + k]), np.array([4]))
        total += math.exp(model.log_p(*places)[-1]) * 0.5 / model.rare_mass[k]
    assert abs(total - 1) < 1e-4


def test_every_place_of_a_text_trains(spark, make_docs):
    model, _ = lm.fit(make_docs([(1, "alpha beta")]), F.col("doc_id"), rounds=1)
    words, at, ends = lm.tokens_of(pa.array([b"alpha beta"]))
    cls, _, rows_1, _ = model.places(model.encode(words)[1][at], ends)
    assert len(cls) == 3 and model.w1[rows_1].any(axis=2).all()


def test_tokens_as_python_splits_them():
    texts = [None, b"", b" \t\n", b"A bC\x0b\x0cd\r\n e ", "Ä\u00a0É x\u2003y".encode(), b"\xff \xfeA", b"\x1cq\x1d r\x00", b"x" * 5000]
    words, at, ends = lm.tokens_of(pa.array(texts, pa.binary()))
    got = [words[int(i)].as_py() for i in at]
    assert [got[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [(t or b"").lower().split() + [b""] for t in texts]
