"""Repeated substrings: content-chosen anchors deal out the text, difference-cover suffix sorting finds the repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import batches_of, stash

LENGTH = 200  # bytes of a repeat
GRAM = 64  # bytes that an anchor hashes
BATCH = 1 << 20  # bytes sorted together, below 2**21 so that three names fit 63 bits
HOT = 2_000  # contexts of a bucket beyond which it is refined
#: Fixed odd multipliers of the rolling hash and its finish.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
BYTE = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


# Difference-cover suffix sorting


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sorted order of keys, the dense rank of each from 1, and whether all ranks differ."""
    order = np.argsort(keys, kind="stable")
    step = np.concatenate(([1], (keys[order[1:]] != keys[order[:-1]]).astype(np.int64)))
    rank = np.empty(len(keys), np.int64)
    rank[order] = ranks = np.cumsum(step)
    return order, rank, bool(len(keys) == ranks[-1])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (integers from 1; fewer than 2**21 of them and below 2**21) in order.

    Suffixes at starts 1 and 2 modulo 3 are the difference cover: their triples are sorted and named, and where names
    repeat, the string of names is sorted by recursion. The others follow from one symbol and a sampled rank, and a merge
    compares either kind by at most two symbols and a sampled rank.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s.astype(np.int64), np.zeros(3, np.int64)))
    k = int(t.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a start past the end parts the halves where n % 3 == 1
    sample = np.concatenate((one, two))
    order, rank, unique = _names((t[sample] * k + t[sample + 1]) * k + t[sample + 2])
    if not unique:
        order = suffix_array(rank)
        rank[order] = np.arange(1, len(order) + 1)
    at = np.zeros(n + 3, np.int64)
    at[sample] = rank
    sorted_12 = sample[order]
    sorted_12 = sorted_12[sorted_12 < n]
    zero = np.arange(0, n, 3)
    width = n + 3
    zero = zero[np.argsort(t[zero] * width + at[zero + 1], kind="stable")]
    ones, twos = sorted_12[sorted_12 % 3 == 1], sorted_12[sorted_12 % 3 == 2]
    smaller = np.searchsorted(t[ones] * width + at[ones + 1], t[zero] * width + at[zero + 1])
    smaller += _below(t, at, twos, zero)
    out = np.empty(n, np.int64)
    place = smaller + np.arange(len(zero))
    out[place] = zero
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = sorted_12
    return out


def _below(t: np.ndarray, at: np.ndarray, twos: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Of each suffix in zero, how many in twos sort before it: by two symbols and the sampled rank after them."""
    both = np.concatenate((twos, zero))
    _, pair, _ = _names(t[both] * (int(t.max()) + 1) + t[both + 1])
    key = pair * (len(at) + 1) + at[both + 2]
    return np.searchsorted(key[: len(twos)], key[len(twos) :])


def equal_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For neighbours order[i], order[i + 1]: whether their first `length` bytes are the same. text has room behind."""
    packed = np.lib.stride_tricks.sliding_window_view(text, 8)
    words = np.ascontiguousarray(packed).view(np.uint64).ravel()
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    for off in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same = same[words[a[same] + off] == words[b[same] + off]]
        if not len(same):
            break
    out = np.zeros(len(a), bool)
    out[same] = True
    return out


# Anchors


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every window of `width` elements, by doubling."""
    span, y = 1, x
    while span * 2 <= width:
        y = pick(y[:-span], y[span:])
        span *= 2
    return pick(y[: len(y) - (width - span)], y[width - span :]) if span < width else y


def anchors(text: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of chosen grams: each run of `length` bytes holds one whose hash depends on the run alone.

    The least hash of any length - gram + 1 grams in a row is chosen. Where it occurs more than once (periodic text),
    occurrences a window apart are enough.
    """
    if len(text) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, span, power = BYTE[text], 1, np.uint64(BASE)
    while span < gram:
        h = h[:-span] * power + h[span:]
        with np.errstate(over="ignore"):
            power = power * power
        span *= 2
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(MIX)
    h ^= h >> np.uint64(32)
    width = length - gram + 1
    low = _sliding(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    best = _sliding(np.concatenate((pad, low, pad)), width, np.maximum)
    at = np.flatnonzero(best == h)
    if len(at) > 2:
        value = h[at]
        tie = (value[1:] == value[:-1]) & (np.diff(at) < width)
        if (inner := tie[1:] & tie[:-1]).any():
            keep, last = np.ones(len(at), bool), at[0]
            for i in range(1, len(at) - 1):
                if inner[i - 1] and at[i + 1] - last <= width:
                    keep[i] = False
                else:
                    last = at[i]
            at = at[keep]
    return at, h[at]


def _key(text: bytes) -> tuple[int, int]:
    d = hashlib.sha256(text).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:16], "little", signed=True)


def _anchored(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # copies within a task give their anchors once
        for batch in batches_of(batches, 0):
            for value in batch.column(0).to_pylist():
                if not value or len(value) < length or (k := _key(value)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(k)
                at, h = anchors(np.frombuffer(value, np.uint8), length, gram)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(n, k[0])), pa.array(np.full(n, k[1])), pa.array(at.astype(np.int32))], ["h", "k1", "k2", "at"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in run(batches):
            held.append(b)
            if sum(x.num_rows for x in held) >= 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return packed


def _contexts(length: int, gram: int):
    """The bytes within reach of each anchor: all strings of the length that hold its gram, which begins at p."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 2, 64, 1 << 20):
            for k1, k2, text, anchors_ in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                for s in range(0, len(anchors_), 2_000):
                    part = sorted((x["at"], x["h"], x["hot"]) for x in anchors_[s : s + 2_000])
                    lo = [max(0, at - (length - gram)) for at, _, _ in part]
                    cols = [[h for _, h, _ in part], [k1] * len(part), [k2] * len(part), lo, [at - i for (at, _, _), i in zip(part, lo, strict=True)], [text[i : at + length] for (at, _, _), i in zip(part, lo, strict=True)], [hot for _, _, hot in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], ["h", "k1", "k2", "lo", "p", "ctx", "hot"])

    return run


def halves(p: int, q: int, size: int, length: int) -> list[tuple[int, int, int, int]]:
    """(new p, new q, begin, end) of up to two parts of a context of the size whose bytes p to q are known.

    A string of the length that holds p to q reaches either half of what it lacks, or more, to the right, or else the rest
    to the left. Each part knows that much more, and goes from begin to end: what strings with it reach.
    """
    lack = length - (q - p)
    right = (lack + 1) // 2
    parts = []
    for a, b in ((p, q + right), (p - (lack - right + 1), q)):
        lo, hi = max(0, b - length), min(size, a + length)
        if a >= 0 and b <= size and b - a <= length and hi - lo >= length:
            parts.append((a - lo, b - lo, lo, hi))
    return parts


def _refined(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, k1, k2, lo, p, q, ctx, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b, i, j in halves(p, q, len(ctx), length):
                    known = hashlib.blake2b(ctx[i + a : i + b], digest_size=8, key=(h % 2**64).to_bytes(8, "little") + bytes([a == p - i])).digest()
                    rows.append((int.from_bytes(known, "little", signed=True), k1, k2, lo + i, a, b, ctx[i:j], many))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "k1", "k2", "lo", "p", "q", "ctx", "many"])

    return run


def repeated(contexts: list[bytes], places: np.ndarray, length: int) -> list[np.ndarray]:
    """Of each of some distinct byte strings, the starts of `length`-byte strings that start elsewhere too.

    places: where each string begins in the corpus (overlapping strings of one text see the same bytes), or -1 if it
    begins at several places.
    """
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    n, m = len(text), len(contexts)
    s = np.empty(n + m, np.int64)  # each context ends in a symbol of its own
    shift = np.repeat(np.arange(m), sizes)
    s[np.arange(n) + shift] = text.astype(np.int64) + m + 1
    s[begin + sizes + np.arange(m)] = np.arange(1, m + 1)
    order = suffix_array(s)
    owner = np.repeat(np.arange(m), sizes + 1)
    room = (begin + sizes + np.arange(m))[owner] - np.arange(n + m)
    order = order[room[order] >= length]
    whole = np.zeros(n + m + length + 8, np.uint8)
    whole[np.arange(n) + shift] = text
    hit = np.zeros(n + m, bool)
    if len(order) > 1:
        first = np.flatnonzero(np.concatenate(([True], ~equal_prefixes(whole, order, length))))
        own = owner[order]
        place = places[own] + order - (begin + np.arange(m))[own]
        many = np.logical_or.reduceat(places[own] < 0, first) | (np.minimum.reduceat(place, first) != np.maximum.reduceat(place, first))
        size = np.diff(np.append(first, len(order)))
        hit[order[np.repeat(many & (size > 1), size)]] = True
    at = np.flatnonzero(hit)
    parts = np.split(at, np.searchsorted(at, (begin + np.arange(m))[1:]))
    return [p - b for p, b in zip(parts, begin + np.arange(m), strict=True)]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merged [first, end) of the intervals that begin at sorted starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    first, last = np.concatenate((starts[:1], starts[gap + 1])), np.concatenate((starts[gap], starts[-1:]))
    return list(zip(first.tolist(), (last + length).tolist(), strict=True))


def _sorted_buckets(length: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h, ctx, k1, k2, lo, many) come sorted, and no bucket is large. Several are sorted at a time."""
        rows: list[tuple[int, int, int, int]] = []  # k1, k2, lo, number of the context
        ctx: list[bytes] = []
        many: list[bool] = []  # whether a context occurs more than once: then all of it repeats
        size, h_now, mark = 0, None, (0, 0)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, ctx, many, size
            if ctx:
                texts_of: dict[tuple[int, int], int] = {}
                places = np.full(len(ctx), -1, np.int64)
                for a, b, c, d in rows:
                    if not many[d]:
                        places[d] = (texts_of.setdefault((a, b), len(texts_of)) << 32) + c
                spans = [_runs(s, length) for s in repeated(ctx, places, length)]
                out = [(k1, k2, lo + i, lo + j) for k1, k2, lo, c in rows for i, j in ([(0, len(ctx[c]))] if many[c] else spans[c])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["k1", "k2", "a", "b"])
            rows, ctx, many, size = [], [], [], 0

        for batch in batches:
            for h, text, k1, k2, lo, more in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if h != h_now:
                    if len(ctx) - mark[1] == 1 and not many[mark[1]]:  # alone: nothing repeats
                        rows, ctx, many = rows[: mark[0]], ctx[: mark[1]], many[: mark[1]]
                    if size > batch_bytes // 4 or len(rows) > 50_000:
                        yield from flush()
                    h_now, mark = h, (len(rows), len(ctx))
                if len(ctx) > mark[1] and ctx[-1] == text:
                    if rows[-1][:3] == (k1, k2, lo) and not more:
                        continue  # two anchors of one text with the same reach
                    many[-1] = True
                else:
                    ctx.append(text)
                    many.append(more)
                    size += len(text) + 1
                rows.append((k1, k2, lo, len(ctx) - 1))
        yield from flush()

    return run


def _merged(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 2):
            out = []
            for k1, k2, text, spans in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                keep, removed, n, at = hashlib.sha256(), 0, 0, 0
                edge = None
                for s in sorted((x["a"], x["b"]) for x in spans):
                    if edge is None or s[0] > edge[1]:
                        if edge:
                            keep.update(text[at : edge[0]])
                            removed, n, at = removed + edge[1] - edge[0], n + 1, edge[1]
                        edge = list(s)
                    else:
                        edge[1] = max(edge[1], s[1])
                if edge:
                    keep.update(text[at : edge[0]])
                    removed, n, at = removed + edge[1] - edge[0], n + 1, edge[1]
                keep.update(text[at:])
                out.append((k1, k2, removed, n, keep.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "n_removed", "n_spans", "kept"])

    return run


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, 1):
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        sha = [hashlib.sha256(t) for t in texts]
        k1, k2 = ([int.from_bytes(x.digest()[i : i + 8], "little", signed=True) for x in sha] for i in (0, 8))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([x.hexdigest() for x in sha], pa.string())], ["doc_id", "n_bytes", "k1", "k2", "sha"])


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, 0):
        texts = batch.column(0).to_pylist()
        keys = [_key(t) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), batch.column(0)], ["k1", "k2", "text"])


SPANS = "k1 long, k2 long, a long, b long"


def _hot_spans(hot: DataFrame, length: int, batch_bytes: int, most: int) -> DataFrame | None:
    """(k1, k2, a, b) from contexts (h, k1, k2, lo, p, q, ctx) whose buckets are too large to sort in one task.

    Level by level: contexts alike in all bytes are one, found by an aggregation with map-side combine, and repeat whole;
    those left are refined by more bytes beside the known ones into buckets of their own, until those are small enough to be
    sorted. At the last level a bucket's strings are one. Contexts only ever split, so nothing is left out.
    """
    key, out = ["h", "p", "q", "ctx"], None
    rows = hot.withColumn("many", F.lit(False))
    while not rows.isEmpty():
        place = F.xxhash64("k1", "k2", "lo")
        once = stash(rows.groupBy(*key).agg(F.bool_or("many").alias("was"), (F.min(place) != F.max(place)).alias("more"), *(F.first(c).alias(c) for c in ("k1", "k2", "lo"))))
        whole = rows.where(~F.col("many")).join(once.where("more or was").select(*key), key, "left_semi")
        spans = [whole.select("k1", "k2", F.col("lo").cast("long").alias("a"), (F.col("lo") + F.octet_length("ctx")).cast("long").alias("b"))]
        fine = stash(once.select("h", "k1", "k2", "lo", "p", "q", "ctx", (F.col("was") | F.col("more")).alias("many")).mapInArrow(_refined(length), "h long, k1 long, k2 long, lo int, p int, q int, ctx binary, many boolean"))
        size = fine.groupBy("h").agg(F.count("*").alias("n"))
        large = stash(size.where(F.col("n") > most).select("h"))
        small = fine.join(large, "h", "left_anti").select("h", "ctx", "k1", "k2", "lo", "many")
        spans.append(small.repartition("h").sortWithinPartitions("h", "ctx", "k1", "k2", "lo").mapInArrow(_sorted_buckets(length, batch_bytes), SPANS))
        found = stash(spans[0].unionByName(spans[1]))
        out = found if out is None else out.unionByName(found)
        rows = fine.join(large, "h", "left_semi").where(F.col("q") - F.col("p") < length)
        ends = fine.join(large, "h", "left_semi").where(F.col("q") - F.col("p") >= length)  # nothing is left to refine by: equal strings are compared whole
        lone = ends.groupBy("h", "ctx").agg((F.bool_or("many") | (F.min(place) != F.max(place))).alias("more")).where("more").select("h", "ctx")
        ended = ends.where(~F.col("many")).join(lone, ["h", "ctx"], "left_semi").select("k1", "k2", F.col("lo").cast("long").alias("a"), (F.col("lo") + length).cast("long").alias("b"))
        out = out.unionByName(stash(ended))
        rows = stash(rows)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch_bytes: int = BATCH, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each text without the bytes of any repeated `length`-byte string.

    A string repeats if it starts at any other place, in the same text or another; overlaps count, all is judged on the
    input, and matches stay within a text. Null counts as empty. Equal texts (repeated rows too) of `length` bytes or
    more lose everything. Texts of any length are worked on whole; an empty table gives none.

    1. Each run of `length` bytes holds an anchor that depends on its bytes alone. Anchors (hash, text key, place) whose
       hash no other place has can't lie in a repeat, and go; that is an aggregation and a join.
    2. For the rest the bytes within reach of the anchor are dealt by hash, so all occurrences of a repeat meet. Each task
       joins buckets to a string of bounded size, sorts its suffixes by the difference cover modulo 3 and compares
       neighbours' first `length` bytes. A bucket of over `hot` anchors (one line under ever new contexts) is first refined
       by the bytes around the anchor, see _hot_spans(); any value of `hot` gives the same rows.
    3. The covered intervals are merged for each text. Equal texts are worked on once, by the first 128 bits of their
       SHA-256.
    """
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = body.schema["doc_id"].dataType.simpleString()
    key = ["k1", "k2"]
    rows = stash(body.mapInArrow(_digested, f"doc_id {kind}, n_bytes long, k1 long, k2 long, sha string"))
    copies = rows.groupBy(*key).agg(F.count("*").alias("copies"))
    long = body.select("text").where(F.length("text") >= length)
    found = stash(long.mapInArrow(_anchored(length, gram), "h long, k1 long, k2 long, at int"))
    place = F.xxhash64(*key, "at")
    per = found.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y")
    per = stash(per.select("h", (F.col("n") > hot).alias("hot")))  # a table of its own: then a hot anchor's rows can be split in the join
    anchored = found.join(per, "h")
    shared = stash(anchored.groupBy(*key).agg(F.collect_set(F.struct("at", "h", "hot")).alias("anchors")))
    texts = long.mapInArrow(_with_key, "k1 long, k2 long, text binary")
    once = stash(texts.join(shared.select(*key), key, "left_semi").groupBy(*key).agg(F.first("text").alias("text")))
    reach = once.join(shared, key).select(*key, "text", "anchors").mapInArrow(_contexts(length, gram), "h long, k1 long, k2 long, lo int, p int, ctx binary, hot boolean")
    reach = stash(reach)
    dealt = reach.where("not hot").select("h", "ctx", *key, "lo", F.lit(False).alias("many")).repartition("h").sortWithinPartitions("h", "ctx", *key, "lo")
    spans = stash(dealt.mapInArrow(_sorted_buckets(length, batch_bytes), SPANS))
    refined = _hot_spans(reach.where("hot").select("h", *key, "lo", "p", (F.col("p") + gram).alias("q"), "ctx"), length, batch_bytes, hot)
    spans = spans if refined is None else spans.unionByName(refined)
    spans = spans.select(*key, F.struct("a", "b").alias("s")).groupBy(*key).agg(F.collect_set("s").alias("spans"))
    cut = once.join(spans, key).select(*key, "text", "spans").mapInArrow(_merged(length), "k1 long, k2 long, n_removed long, n_spans long, kept string")
    per = copies.join(cut, key, "left").select(*key, "copies", "n_removed", "n_spans", "kept")
    out = rows.join(per, key)
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
