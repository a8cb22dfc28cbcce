import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tests.conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import queries, suffix, tokens
from tests.llm.conftest import ODD

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def removed(texts, length):
    """Of each text its bytes' removal flags, by looking at every window."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = True
        out.append(hit)
    return out


def expected(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    out = []
    for r, t, hit in zip(rows, texts, removed(texts, length), strict=True):
        spans = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        out.append((r[0], len(t), int(hit.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~hit].tobytes()).hexdigest()))
    return Counter(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(s):
    assert suffix.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_of_long_strings():
    rng = np.random.default_rng(1)
    for s in (np.ones(500, np.int64), np.tile([1, 2, 3], 200), rng.integers(1, 5, 3000)):
        assert suffix.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_every_window_holds_an_anchor_of_its_own():
    rng = random.Random(2)
    for body in ("".join(rng.choice("ab") for _ in range(3000)), "ab" * 900, "x" * 1200, "".join(rng.choice("abcdefgh") for _ in range(2000))):
        t = np.frombuffer(body.encode(), np.uint8)
        at, h = suffix.anchors(t, 40, 16)
        chosen = dict(zip(at.tolist(), h.tolist(), strict=True))
        by = {}
        for i in range(len(t) - 39):
            inside = {chosen[a] for a in range(i, i + 25) if a in chosen}
            assert inside
            least = by.setdefault(bytes(t[i : i + 40]), inside)
            assert least & inside  # occurrences of a window share a bucket


def test_query_against_every_window(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, queries.op4_suffix_dedup(spark, SF).collect())) == expected(rows, 200)


@pytest.mark.parametrize(("batch", "hot"), [(1 << 20, 2_000), (600, 3)])
def test_repeats_inside_and_across_texts(spark, make_docs, batch, hot):
    """A low bound on buckets sends most of them through all the levels of refinement."""
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, line = piece(70), piece(45)
    rows = [(i, piece(rng.randrange(0, 200)) + (shared if i % 3 == 0 else "") + piece(30) + (line * (i % 4)) + piece(20)) for i in range(40)]
    rows += [(100, "z" * 300), (101, "xy" * 200), (102, rows[5][1]), (103, rows[6][1]), (103, rows[6][1]), (104, None), (105, ""), (None, piece(100)), (106, shared), (107, "z" * 39)]
    got = suffix.remove_repeats(make_docs(rows), length=40, gram=16, batch_bytes=batch, hot=hot)
    assert Counter(map(tuple, got.collect())) == expected(rows, 40)


def test_suffix_odd_rows(spark, make_docs):
    assert Counter(map(tuple, suffix.remove_repeats(make_docs(ODD)).collect())) == expected(ODD, 200)
    assert suffix.remove_repeats(make_docs([])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_every_string_of_a_context_is_in_one_half(data):
    length, size = 40, data.draw(st.integers(40, 64))
    p = data.draw(st.integers(0, size - 16))
    q = data.draw(st.integers(p + 1, min(size, p + 39)))
    parts = suffix.halves(p, q, size, length)
    assert all(b - a > q - p for a, b, _, _ in parts)
    for s in range(size - length + 1):
        if s <= p and q <= s + length:
            assert sum(lo <= s and s + length <= hi and s - lo <= a and b <= s - lo + length for a, b, lo, hi in parts) == 1


def reference(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return [len(sp.encode(t or "")) for t in texts]


def test_token_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op6_token_counts(spark, SF).collect()
    assert [r.n_tokens for r in got] == reference([rows[r.doc_id] for r in got])
    assert all(r.n_bytes == len(rows[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 4096) for r in got) and len(got) == len(rows)


def test_tokens_of_odd_rows(spark, make_docs):
    got = tokens.token_counts(make_docs(ODD), MODEL).collect()
    want = Counter((r[0], len((r[1] or "").encode()), n, n > 4096) for r, n in zip(ODD, reference([r[1] for r in ODD]), strict=True))
    assert Counter(map(tuple, got)) == want
    assert tokens.token_counts(make_docs([]), MODEL).count() == 0


@pytest.fixture(scope="module")
def merges():
    return tokens.Merges(MODEL)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_as_the_library(merges, text):
    assert tokens.count_batch([text], merges, {}) == reference([text])


def one_at_a_time(merges, word):
    """The symbols left of a word, merging the lowest-rank pair, the leftmost of equals, once a step."""
    pairs = {int(k): (int(r), int(i)) for k, r, i in zip(merges.keys, merges.rank, merges.into, strict=True)}
    symbols = {int(p): int(s) for p, s in zip(merges.point, merges.symbol, strict=True)}
    sym = [symbols.get(ord(c), merges.n - 1) for c in word]
    more = sum(len(c.encode()) - 1 for c, s in zip(word, sym, strict=True) if s == merges.n - 1)
    while True:
        found = min(((pairs[k][0], i, pairs[k][1]) for i in range(len(sym) - 1) if (k := sym[i] * merges.n + sym[i + 1]) in pairs), default=None)
        if found is None:
            return len(sym) + more
        sym[found[1] : found[1] + 2] = [found[2]]


def test_sequences_of_any_length_as_one_merge_at_a_time(merges):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü語") for _ in range(n)) for n in (1, 2, 50, 150, 191, 400, 1000)] + ["a" * 190, "aaab" * 60, "<s>", "▁▁▁a"]
    assert merges.counts(words) == [one_at_a_time(merges, w) for w in words]
    long = ["".join(rng.choice("etaoinshrd") for _ in range(n)) for n in (3000, 40_000)] + ["x" * 50_000, "ab" * 30_000]
    assert tokens.count_batch(words + long, merges, {}) == reference(words + long)
