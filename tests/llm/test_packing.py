import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF
from tests.llm.conftest import ODD
from tessella.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, length, path=PATH, end=1):
    """Every document's ids once, in order; sequences whole, gapless, and without padding."""
    library = Tokenizer.from_file(path)
    want = defaultdict(list)
    for d in docs:
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, end], "<u4")
        want[d.doc_id].append(ids)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == set(want)
    for k, pieces in got.items():
        def crcs(cuts, ids):
            return [zlib.crc32(ids[a : a + n].tobytes()) for a, n in cuts]

        cover = defaultdict(int)
        for r in pieces:
            cover[r.doc_tokens] += r.length
            assert any(len(ids) == r.doc_tokens and crcs([(r.start, r.length)], ids) == [r.ids_crc32] for ids in want[k])
        total = defaultdict(int)
        for ids in want[k]:
            total[len(ids)] += len(ids)
        assert cover == total
        if len(want[k]) == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.length > 0
                at += r.length
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and (at == length or at & (at - 1) == 0)
    return sequences


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check(queries.op13_packing(spark, SF).collect(), docs, 2048)


@pytest.mark.parametrize("group", [3, 1000])
def test_odd_rows(spark, make_docs, group):
    rows = [*ODD, *[(70 + i, "tail of words " * i) for i in range(40)]]
    df = make_docs(rows)
    sequences = check(packing.pack(df, PATH, 64, 1, group).collect(), df.select("doc_id", "text").collect(), 64)
    short = [p for p in sequences.values() if sum(r.length for r in p) < 64]
    assert len(short) <= 6 * (1 + len(rows) // group)
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_ids_are_kept(spark, make_docs):
    rows = [(i, "some words to be packed " * (7 * i)) for i in range(1, 9)]
    out = packing.pack(make_docs(rows), PATH, 64, 1, keep_ids=True).collect()
    library = Tokenizer.from_file(PATH)
    for k, text in rows:
        parts = sorted((r for r in out if r.doc_id == k), key=lambda r: r.start)
        assert [i for r in parts for i in r.ids] == [*library.encode(text, add_special_tokens=False).ids, 1]
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in parts)


def plain(sizes, length, linear, quadratic):
    """Descending, each into the cheapest sequence with room; where none has, the emptiest takes what fits."""
    room = packing.capacities(sum(sizes), length)
    cost, out = [0.0] * len(room), []
    items = [(-n, 0, i, 0) for i, n in enumerate(sizes) if n]  # whole items before rests of the same size
    while items:
        items.sort()
        size, _, item, start = items.pop(0)
        size = -size
        fits = [s for s in range(len(room)) if room[s] >= size]
        if fits:
            s, takes = min(fits, key=lambda s: (cost[s], s)), size
        else:
            takes = max(room)
            s = max(x for x in range(len(room)) if room[x] == takes)
            items.append((takes - size, 1, item, start + takes))
        out.append((item, start, takes, s))
        room[s] -= takes
        cost[s] += linear * takes + quadratic * takes * takes
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 32), max_size=40))
def test_balanced_fills_every_sequence(sizes):
    item, start, size, sequence = packing.balanced(np.array(sizes, np.int64), 32)
    room = packing.capacities(sum(sizes), 32)
    assert np.bincount(sequence, size, len(room)).tolist() == room if len(item) else not sum(sizes)
    held = defaultdict(list)
    for i, a, n in zip(item.tolist(), start.tolist(), size.tolist()):
        held[i].append((a, n))
    for i, n in enumerate(sizes):
        at = 0
        for a, k in sorted(held[i]):
            assert a == at
            at += k
        assert at == n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=14))
def test_whole_items_go_where_a_plain_search_puts_them(sizes):
    """As long as nothing is cut, each goes to the cheapest sequence with room, as a search of all sequences finds it."""
    got = list(zip(*(c.tolist() for c in packing.balanced(np.array(sizes, np.int64), 16))))
    for a, b in zip(got, plain(sizes, 16, packing.LINEAR, packing.QUADRATIC)):
        if b[2] < sizes[b[0]]:
            break
        assert a == b


def test_cost_is_balanced():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 2048, 4000)
    item, start, size, sequence = packing.balanced(sizes, 2048)
    cost = np.bincount(sequence, size + size * size / 1024.0)
    shuffled = rng.permutation(len(sizes))
    upto = np.cumsum(sizes[shuffled])
    naive = np.bincount((upto - 1) // 2048, sizes[shuffled] + sizes[shuffled] ** 2 / 1024.0)
    assert cost[cost > 100].std() < 0.5 * naive.std()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("aA'sSİΣſ<|>endoftxé́ \t\x0b\x1c\x85  .1²", max_size=40))
def test_words_give_the_librarys_ids(text):
    words = packing._LOADED.get(PATH) or packing._LOADED.setdefault(PATH, packing.Words(PATH))
    assert np.frombuffer(words.ids([text.encode()])[0], "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_every_token_is_reached_as_the_library_reaches_it():
    """The merges by ranks of bytes are those by pairs: each token's own text gives that token alone, or what the library gives."""
    words = packing.Words(PATH)
    texts = [t.replace("</w>", "") for t in words.tokenizer.get_vocab() if t.isascii() and "<|" not in t]
    assert words.merges is not None and len(texts) > 40_000
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        assert words.ids([t.encode() for t in part]) == [words.encoded(t) for t in part]


def test_special_strings_and_long_texts():
    words = packing.Words(PATH)
    for text in ("a<|endoftext|>b <|startoftext|> <|endoftext", "word " * 2_000_000, "x" * 5000 + " y", ("é" * 3000 + " ") * 3):
        assert np.frombuffer(words.ids([text.encode()])[0], "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert not any(len(w) > packing.LONG for w in words.known)
