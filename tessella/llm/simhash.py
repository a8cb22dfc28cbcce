"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import batches_of, free_names, stash
from tessella.operators.graph import components

SEED = 42
CHUNK = 1 << 15
#: Blocks and how many of them a table's key holds. 7 and 3: any pair at 4 bits of 64 or fewer meets in a table.
SURE = (7, 3)
#: The same for the bits that a run's key leaves open, where the run is too long for one task.
FINER = (6, 2)
RUN = 4096  # fingerprints of a run that are compared in one task


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (rows of little-endian bytes) set each bit."""
    bits = np.unpackbits(hashes, axis=1, bitorder="little")
    total = np.zeros(bits.shape[1], np.int64)
    for at in range(0, len(bits), 255):  # eight counters of a byte in each 64-bit sum
        part = bits[at : at + 255].view(np.uint64).sum(axis=0, dtype=np.uint64)
        total += part.view(np.uint8)
    return total


def spans_of(words: list[bytes], width: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and where each of their shingles begins and ends (one shingle if they are fewer)."""
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return joined, [0], [len(joined)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return joined, starts[: n - width + 1].tolist(), ends[width - 1 :].tolist()


def fingerprint(text: bytes, width: int) -> int:
    """64 bits, each set if it is set in over half the XXH64 of the text's word shingles; 0 if it has no word."""
    words = text.lower().split()  # bytes.lower() and split() know A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined, starts, ends = spans_of(words, width)
    total, m, digest = np.zeros(64, np.int64), len(starts), xxhash.xxh64_intdigest
    for at in range(0, m, CHUNK):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], np.uint64)
        total += votes(h.view(np.uint8).reshape(-1, 8))
    return int(np.packbits(total * 2 > m, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long). A null text counts as one without words."""
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1):
            fp = np.array([fingerprint(t or b"", width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return chosen.mapInArrow(run, "doc_id long, fp long")


def masks(bits: int, blocks: int, whole: int) -> list[int]:
    """Of each choice of `whole` blocks, the mask of their bits."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in c) for c in combinations(range(blocks), whole)]


Gap = Callable[[np.ndarray, np.ndarray | int], np.ndarray]


def forest(words: np.ndarray, distance: int, gap_of: Gap | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, bits): a minimal spanning forest of distinct fingerprints (rows of 64-bit words), edges at the distance or less.

    gap_of(rows, row): the distances, if not the differing bits.

    It connects what all such pairs connect, at this distance and at any smaller one, by fewer edges than there are rows;
    pairs are looked at row by row and never kept.
    """
    n = len(words)
    left = np.arange(1, n)
    best, by = np.full(n - 1, np.iinfo(np.int32).max, np.int32), np.zeros(n - 1, np.int64)
    x, y, d, now = [], [], [], 0
    while len(left):
        gap = gap_of(left, now) if gap_of else np.bitwise_count(words[left] ^ words[now]).sum(axis=1, dtype=np.int32)
        nearer = gap < best
        best[nearer], by[nearer] = gap[nearer], now
        i = int(best.argmin())
        now = int(left[i])
        if best[i] <= distance:
            x.append(by[i])
            y.append(now)
            d.append(best[i])
        left, best, by = (np.delete(z, i) for z in (left, best, by))
    return np.array(x, np.int64), np.array(y, np.int64), np.array(d, np.int32)


def _linked(distance: int, most: int):
    """Rows are (mask, key, fp), sorted; a run of over `most` gives its rows back as (fp, null, null, mask, key)."""
    def pairs(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, ...]:
        u = fp.view(np.uint64)[:, None]
        new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(fp)))
        out, group = [], np.cumsum(new)
        small = np.repeat(run, run) <= 8
        for off in range(1, 8):
            i = np.flatnonzero((group[off:] == group[:-off]) & small[off:])
            gap = np.bitwise_count(u[i] ^ u[i + off]).sum(axis=1, dtype=np.int32)
            near = gap <= distance
            out.append((fp[i[near]], fp[i[near] + off], gap[near]))
        for s, n in zip(first[run > 8].tolist(), run[run > 8].tolist(), strict=True):
            i, j, gap = forest(u[s : s + n], distance)
            out.append((fp[s + i], fp[s + j], gap))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def found(*rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b, d = pairs(*rows)
        if len(a):
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d), none, none], ["a", "b", "bits", "mask", "key"])

    def dense(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        none = pa.nulls(len(fp), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(fp), none, none.cast(pa.int32()), pa.array(mask), pa.array(key)], ["a", "b", "bits", "mask", "key"])

    return _by_run(found, 1, np.int64, most, dense)


def _by_run(found: Callable[..., Iterator[pa.RecordBatch]], longs: int, first: type = np.int32, most: int | None = None, dense: Callable[..., Iterator[pa.RecordBatch]] | None = None):
    """Rows are (first, key long, and so many longs more), sorted; found() is given whole runs of the first two.

    With most, runs longer than that go to dense() instead, in parts: no run is held whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All but the last run of what has been read is whole."""
        held = [np.empty(0, first), *(np.empty(0, np.int64) for _ in range(1 + longs))]
        waiting: list[list[np.ndarray]] = []
        going: tuple | None = None  # the long run whose rows have begun to go out

        def split(rows: list[np.ndarray], ended: bool) -> Iterator[pa.RecordBatch]:
            """Give out whole runs; what is left over stays in held."""
            nonlocal held, going
            if not len(rows[0]):
                held = rows
                return
            edge = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            starts, ends = np.concatenate(([0], edge)), np.append(edge, len(rows[0]))
            long = ends - starts > most if most else np.zeros(len(starts), bool)
            if going == (rows[0][0], rows[1][0]):
                long[0] = True
            last = len(starts) - (0 if ended or long[-1] else 1)
            for i in np.flatnonzero(long):
                yield from dense(*(r[starts[i] : ends[i]] for r in rows))
            rest = np.repeat(~long[:last], (ends - starts)[:last])
            upto = len(rest)
            if rest.sum() > 1:
                yield from found(*(r[:upto][rest] for r in rows))
            going = (rows[0][-1], rows[1][-1]) if long[-1] else None
            held = [r[upto:] for r in rows]

        for batch in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(x[0]) for x in waiting) < max(1 << 16, len(held[0])):
                continue
            rows = [np.concatenate([h, *(w[k] for w in waiting)]) for k, h in enumerate(held)]
            waiting = []
            yield from split(rows, False)
        yield from split([np.concatenate([h, *(w[k] for w in waiting)]) for k, h in enumerate(held)], True)

    return run


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (open, fp) of long runs, open the bits in which the run differs, under keys that hold FINER's share of those too.

    mask and key are the bits held and their values alone, so rows that come from different runs to the same key are equal.
    """
    for batch in batches:
        opened, fp = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
        for m in np.unique(opened):
            own = fp[opened == m]
            bits = [b for b in range(64) if int(m) >> b & 1]
            edges = [len(bits) * i // FINER[0] for i in range(FINER[0] + 1)]
            blocks = [sum(1 << b for b in bits[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            for c in combinations(blocks, FINER[1]):
                mask = ~m | np.uint64(sum(c))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), mask, np.uint64).view(np.int64)), pa.array((own & mask).view(np.int64)), pa.array(own.view(np.int64))], ["mask", "key", "fp"])


def links(fps: DataFrame, distance: int = 4, most: int = RUN) -> DataFrame:
    """(a, b, bits): edges between distinct fingerprints (fp) that connect all pairs within the distance, 4 at most.

    The 64 bits are split into blocks, and a table for each choice of some of them keys a row by those; every pair at 4
    bits or fewer meets. Rows are dealt by (mask, key) and sorted there; a run is verified by XOR and bit count, and gives
    at most 8 * 7 / 2 pairs or a spanning forest. A run of over `most` rows (16 at least) is dealt again by blocks of the bits in
    which its rows differ, in which such a pair meets too. Rows that reach one key from several runs are one, so runs shrink
    from level to level, and any value of `most` connects the same.
    """
    most = max(most, 16)
    if distance > 4:
        raise ValueError("these blocks find pairs at 4 bits or fewer")
    kind = "a long, b long, bits int, mask long, key long"
    signed = lambda m: m - 2**64 if m >> 63 else m
    keyed = F.explode(F.array(*(F.struct(F.lit(signed(m)).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for m in masks(64, *SURE))))
    rows, out = fps.select("fp", keyed.alias("x")).select("x.mask", "x.key", "fp"), None
    while True:
        met = stash(rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_linked(distance, most), kind))
        found = met.where("b is not null").select("a", "b", "bits")
        out = found if out is None else out.unionByName(found)
        dense = met.where("b is null").select("mask", "key", F.col("a").alias("fp"))
        if dense.isEmpty():
            return out
        differ = dense.groupBy("mask", "key").agg(F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("open"))
        rows = dense.join(differ, ["mask", "key"]).select("open", "fp").distinct().mapInArrow(_finer, "mask long, key long, fp long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints link, directly or over others, share a component.

    The component is its smallest doc_id. Repeated rows and equal texts share a fingerprint, so they link; texts without
    words (null, empty, white space) all have fingerprint 0. A null doc_id never becomes a component's id unless all are.
    Texts of any length are fingerprinted whole; an empty table gives none.
    """
    fp = stash(fingerprints(docs, width, doc_id, text))
    reps = stash(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = components(links(reps.select("fp"), distance), "a", "b")
    reps = reps.join(of, reps.fp == of.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    low = reps.groupBy("root").agg(F.min("least").alias("component_id"))
    named = reps.join(low, "root").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# One document of each group of similar ones

LONG = 512  # bits of the fingerprint that measures similarity
WORDS = tuple(f"w{i}" for i in range(LONG // 64))
SIMILAR = 0.8
DOUBT = 0.12  # similarity within which 512 bits may err: three standard deviations
APART = 0.2  # below the similarity by more than this, the sets aren't compared: five standard deviations
SHORT = 64  # shingles; fingerprints of fewer say too little, so such texts' sets are always compared
NEAR = 4  # of the fingerprint's first 64 bits: at so many differing ones or fewer, every pair meets in a block
BLOCKS = -1  # stands for a table's number where a group comes from the blocks
#: Tables, and minima that a table's key holds: at the similarity 0.8 all of them differ for one pair of 95,000.
TABLES, MINIMA = 16, 3


def most_bits(similarity: float, bits: int = LONG) -> int:
    """Differing bits expected of two shingle sets of one size at the Jaccard similarity: their angle's share of pi."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


STEP = np.arange(1, LONG // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
LEAST = np.uint32(0xFFFFFFFF)


def _wide(text: bytes, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many shingles the text has; a fingerprint of them in 64-bit words; and keys of their minima, one a table.

    Two texts have the same least shingle under a hash with the probability of their Jaccard similarity, however they differ.
    """
    words = text.lower().split()
    total, n, least = np.zeros(LONG, np.int64), 0, np.full((MINIMA, TABLES), LEAST)
    if words:
        joined, starts, ends = spans_of(words, width)
        seen = {joined[i:j] for i, j in zip(starts, ends, strict=True)}
        base = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
        n = len(base)
        for at in range(0, n, 1 << 13):
            part = base[at : at + (1 << 13), None] + STEP
            part ^= part >> np.uint64(30)
            part *= np.uint64(0xBF58476D1CE4E5B9)
            part ^= part >> np.uint64(27)
            part *= np.uint64(0x94D049BB133111EB)
            part ^= part >> np.uint64(31)
            total += votes(part.view(np.uint8).reshape(len(part), -1))
            part ^= part >> np.uint64(32)
            for k in range(MINIMA):
                least[k] = np.minimum(least[k], (part * ODD[k]).view(np.uint32).min(axis=0))
    key = np.zeros(TABLES, np.uint64)
    for k in range(MINIMA):
        key = (key + least[k]) * ODD[k]
        key ^= key >> np.uint64(29)
    return n, np.packbits(total * 2 > n, bitorder="little").view(np.int64), key.view(np.int64)


def _wide_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1):
            texts = batch.column(1).to_pylist()
            rows = [_wide(t or b"", width) for t in texts]
            nodes = [xxhash.xxh3_64_intdigest(long.tobytes() + key.tobytes()) - 2**63 for _, long, key in rows]
            h = [xxhash.xxh3_64_intdigest(t) - 2**63 if t is not None else None for t in texts]
            words = np.array([r[1] for r in rows], np.int64).reshape(-1, len(WORDS))
            keys = pa.array([r[2].tolist() for r in rows], pa.list_(pa.int64()))
            cols = [pa.array(h, pa.int64()), pa.array(nodes, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), *map(pa.array, words.T.copy()), keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "h", "node", "size", *WORDS, "keys"])

    return run


WHOLE = 16_384  # texts of a run that give a forest in one task
LEADERS = 1024  # of a longer run, texts that the others are compared with as they pass
CELL = 512  # texts of a block, two of which one task compares by their sets


def _gaps(close: int, far: int, u: np.ndarray, v: np.ndarray, doubtful: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words; where a text is short, over `close` and `far` at most."""
    gap = np.bitwise_count(u ^ v).sum(axis=-1, dtype=np.int32)
    return np.where(doubtful, np.clip(gap, close + 1, far), gap).astype(np.int32)


def _met(close: int, far: int, whole: int):
    """Of rows (table, key, node, size, words...): pairs at `far` bits or fewer that meet, as (a, b, bits).

    A pair with a text of fewer than SHORT shingles counts as over `close`, and `far` at most. Runs of 8 or fewer give all
    their pairs. Others give a minimal spanning forest, and where its edges of `close` bits don't connect the run, also its
    rows, as (node, null, null, table, key). A run of over `whole` rows is not held: each row that passes is linked to the first
    of a bounded number of leaders within `close`, and all its rows are given.
    """
    held: dict = {"run": None, "lead": np.empty((0, len(WORDS)), np.uint64), "node": np.empty(0, np.int64)}

    def pairs(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(bits, pa.int32()), none.cast(pa.int32()), none], ["a", "b", "bits", "t", "k"])

    def given(table: np.ndarray, key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(node), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(node), none, none.cast(pa.int32()), pa.array(table, pa.int32()), pa.array(key)], ["a", "b", "bits", "t", "k"])

    def found(table: np.ndarray, key: np.ndarray, node: np.ndarray, size: np.ndarray, *words: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, short = np.stack([w.view(np.uint64) for w in words], axis=1), size < SHORT
        gap_of = lambda i, j: _gaps(close, far, u[i], u[j], short[i] | short[j])
        new = np.concatenate(([True], (table[1:] != table[:-1]) | (key[1:] != key[:-1])))
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(node)))
        group, small = np.cumsum(new), np.repeat(run, run) <= 8
        for off in range(1, 8):
            i = np.flatnonzero((group[off:] == group[:-off]) & small[off:])
            gap = gap_of(i, i + off)
            yield pairs(node[i[gap <= far]], node[i[gap <= far] + off], gap[gap <= far])
        for s, n in zip(first[run > 8].tolist(), run[run > 8].tolist(), strict=True):
            x, y, gap = forest(u[s : s + n], far, lambda i, j, s=s: gap_of(i + s, j + s))
            yield pairs(node[s + x], node[s + y], gap)
            if (gap <= close).sum() < n - 1:
                yield given(table[s : s + n], key[s : s + n], node[s : s + n])

    def dense(table: np.ndarray, key: np.ndarray, node: np.ndarray, size: np.ndarray, *words: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield given(table, key, node)
        u = np.stack([w.view(np.uint64) for w in words], axis=1)
        if held["run"] != (table[0], key[0]):
            held.update(run=(table[0], key[0]), lead=u[:0], node=node[:0])
        left = np.flatnonzero(size >= SHORT)
        a, b = [], []

        def linked(lead: np.ndarray, name: int) -> None:
            nonlocal left
            near = np.bitwise_count(u[left] ^ lead).sum(axis=1) <= close
            a.append(node[left[near]])
            b.append(np.full(near.sum(), name))
            left = left[~near]

        for lead, name in zip(held["lead"], held["node"].tolist(), strict=True):
            linked(lead, name)
        while len(left) and len(held["node"]) < LEADERS:
            lead, name = u[left[0]], int(node[left[0]])
            held["lead"], held["node"] = np.concatenate((held["lead"], lead[None])), np.append(held["node"], name)
            left = left[1:]
            linked(lead, name)
        if a and sum(map(len, a)):
            a, b = np.concatenate(a), np.concatenate(b)
            yield pairs(a, b, np.zeros(len(a), np.int32))

    return _by_run(found, 2 + len(WORDS), np.int32, whole, dense)


def _meetings(rows: DataFrame, close: int, far: int, whole: int) -> DataFrame:
    """_met() over rows (t, k, node, size, words)."""
    dealt = rows.select("t", "k", "node", "size", *WORDS).repartition("t", "k").sortWithinPartitions("t", "k", "node")
    return dealt.mapInArrow(_met(close, far, whole), "a long, b long, bits int, t int, k long")


def _near_by_blocks(nodes: DataFrame, close: int, far: int) -> tuple[DataFrame, DataFrame]:
    """Of texts whose first 64 bits differ in NEAR or fewer: pairs (a, b, bits) at `far` bits of all or fewer, and rows (node, t, k).

    links() finds them by pigeonhole blocks, XOR and bit count: its edges connect all that such pairs connect, and texts of one
    fingerprint are linked to the first of them. `bits` counts all bits, as _gaps() does. What similarity leaves apart of a group
    of three or more may have other pairs than these edges, so its rows are given too, with the group as k.
    """
    fp = WORDS[0]
    held = stash(nodes.groupBy(fp).agg(F.min("node").alias("head")))
    edges = stash(links(held.select(F.col(fp).alias("fp")), NEAR).select("a", "b").distinct())
    a, b = (held.select(F.col(fp).alias(k), F.col("head").alias(f"{k}_")) for k in "ab")
    across = edges.join(a, "a").join(b, "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    group = components(edges, "a", "b").select(F.col("node").alias("fp"), "component")
    heads = held.join(group, held[fp] == group["fp"], "left").select(fp, "head", F.coalesce("component", fp).alias("k"))
    member = stash(nodes.select("node", fp).join(heads, fp).select("node", "head", "k"))
    within = member.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    met = across.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for k in "ab":
        met = met.join(nodes.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), *(F.col(w).alias(f"{k}_{w}") for w in WORDS)), k)
    gap = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in WORDS), F.lit(0))
    short = F.least("a_size", "b_size") < SHORT
    gap = F.when(short, F.least(F.greatest(gap, F.lit(close + 1)), F.lit(far))).otherwise(gap).cast("int")
    pairs = stash(met.select("a", "b", gap.alias("bits")).where(F.col("bits") <= far))
    many = member.groupBy("k").count().where("count > 2").select("k")
    return pairs, member.join(many, "k", "left_semi").select("node", F.lit(BLOCKS).alias("t"), "k")


def _joined(close: int, far: int, similarity: float):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of two blocks of texts (or one with itself) the links that join components, by whole sets; of pairs whose first bits are near or that share a minimum's key."""
        t = pa.Table.from_batches(list(batches)).sort_by("node")
        node, component, size, block = (t[c].to_numpy() for c in ("node", "component", "size", "b"))
        u = np.stack([t[w].to_numpy().view(np.uint64) for w in WORDS], axis=1)
        keys = np.array(t["keys"].to_pylist(), np.int64).reshape(len(node), -1)
        sets: dict[int, set] = {}
        packed = t["shingles"].to_pylist()
        of = lambda i: sets[i] if i in sets else sets.setdefault(i, set(np.frombuffer(packed[i] or b"", np.int64).tolist()))
        root, short, a, b = component.copy(), size < SHORT, [], []
        one, two = int(key[1].as_py()), int(key[2].as_py())
        for i in np.flatnonzero(block == one).tolist():
            j = np.arange(i + 1, len(node)) if one == two else np.flatnonzero(block == two)
            j = j[root[j] != root[i]]
            j = j[(np.bitwise_count(u[j, 0] ^ u[i, 0]) <= NEAR) | (keys[j] == keys[i]).any(axis=1)]
            gap = _gaps(close, far, u[j], u[i], short[j] | short[i])
            for k, g in zip(j[gap <= far].tolist(), gap[gap <= far].tolist(), strict=True):
                if root[k] == root[i]:
                    continue
                if g > close:
                    both = len(of(i) & of(k))
                    if both < similarity * (len(of(i)) + len(of(k)) - both):
                        continue
                a.append(node[i])
                b.append(node[k])
                root[root == root[k]] = root[i]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _sets(width: int):
    """Rows (h_, t binary) as (h_, shingles): the hashes of a text's word shingles, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1):
            out = []
            for text in batch.column(1).to_pylist():
                words = (text or b"").lower().split()
                joined, starts, ends = spans_of(words, width)
                seen = {joined[i:j] for i, j in zip(starts, ends, strict=True)}
                out.append(np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["h_", "shingles"])

    return run


def _links_apart(apart: DataFrame, nodes: DataFrame, of: DataFrame, docs: DataFrame, width: int, similarity: float, close: int, far: int, cell: int) -> DataFrame:
    """(a, b): links between components of the runs and groups (node, t, k) that close pairs don't connect.

    The texts of runs that have members in common are cut into blocks, and every two blocks meet in a task that compares what is
    not yet joined, so that no pair is ever a row and no run is held whole: a text travels once for each block of its runs.
    """
    lead = apart.groupBy("t", "k").agg(F.min("node").alias("lead"))
    group = components(apart.join(lead, ["t", "k"]).select("node", "lead"), "node", "lead").withColumnRenamed("component", "cluster")
    asked = stash(nodes.join(group, "node").select("node", "cluster", F.col("h").alias("h_"), "size", *WORDS, "keys"))
    sets = _texts(docs, asked.select("h_").where("h_ is not null").distinct()).mapInArrow(_sets(width), "h_ long, shingles binary")
    rows = asked.join(sets, "h_", "left").join(of, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("h_")
    blocks = asked.groupBy("cluster").agg(F.ceil(F.count("*") / cell).alias("blocks"))
    rows = rows.join(blocks, "cluster").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = rows.withColumns({"one": F.least("b", "o"), "two": F.greatest("b", "o")}).drop("o", "blocks")
    return stash(cells.groupBy("cluster", "one", "two").applyInArrow(_joined(close, far, similarity), "a long, b long"))


FILTER = 1 << 26  # bits of the broadcast filter on text hashes, 8 MB whatever the input


def _filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the hashes modulo FILTER, built by distributed aggregation; 32,768 bits a row."""
    bit = F.pmod(column, F.lit(FILTER)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(bit).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(FILTER // 8, np.uint8)
    for r in parts:
        out[(r.n - 1) * 4096 : r.n * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _possibly(held):
    """Rows (text binary) whose hash may be among the filter's, with the hash; the join after it is exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches_of(batches, 0):
            h = np.array([xxhash.xxh3_64_intdigest(t) - 2**63 if t is not None else 0 for t in batch.column(0).to_pylist()], np.int64)
            at = h % FILTER
            ok = pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(h).filter(ok), batch.column(0).filter(ok)], ["h_", "t"])

    return run


def _text_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, "text"):
        h = [xxhash.xxh3_64_intdigest(t.encode()) - 2**63 if t is not None else None for t in batch.column("text").to_pylist()]
        yield batch.append_column("hash of text", pa.array(h, pa.int64()))


def _keyed_by_text(docs: DataFrame, name: str) -> DataFrame:
    return docs.mapInArrow(_text_hash, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(h_, t): each asked text once, by its hash. A filter of bounded size keeps most others out of the exchange."""
    asked = stash(asked)
    held = docs.sparkSession.sparkContext.broadcast(_filter(asked, "h_"))
    texts = docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(_possibly(held), "h_ long, t binary")
    return stash(texts.join(asked, "h_", "left_semi").groupBy("h_").agg(F.first("t").alias("t")))


def _truly_similar(edges: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of edges (a, b, a_h, b_h), those whose texts' shingle sets reach the Jaccard similarity."""
    texts = _texts(docs, edges.select(F.explode(F.array("a_h", "b_h")).alias("h_")).where("h_ is not null").distinct())
    a, b = (texts.select(F.col("h_").alias(f"{k}_h"), F.col("t").alias(f"t{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shingles(text: bytes) -> set[bytes]:
            words = text.lower().split()
            joined, starts, ends = spans_of(words, width)
            return {joined[i:j] for i, j in zip(starts, ends, strict=True)}

        for batch in batches_of(batches, 2, 64):
            x, y, ok = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            for s, t in zip(x, y, strict=True):
                s, t = shingles(s or b""), shingles(t or b"")
                ok.append(len(s & t) >= similarity * len(s | t))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return edges.select("a", "b", "a_h", "b_h").join(a, "a_h").join(b, "b_h").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def distinct_documents(docs: DataFrame, width: int = 5, similarity: float = SIMILAR, whole: int = WHOLE, cell: int = CELL) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest doc_id (nulls first); all columns kept.

    Two texts are similar if their sets of word shingles have the Jaccard similarity. Candidates are all pairs whose SimHashes
    differ in NEAR of their first 64 bits or fewer, found by pigeonhole blocks; similar texts that lie further apart than blocks
    can be sure of are met in tables over the sets' minima as well. The SimHash's 512 bits tell by their Hamming distance, and
    where that is within DOUBT of the similarity, or texts are short, the sets are compared. Large runs of a table first give a
    minimal spanning forest by that distance (of over `whole` texts, links to leaders); what that, or the edges of a group of
    near fingerprints, leaves apart is compared in blocks of about `cell` texts, two in a task, until it is joined. Groups are
    the components. Texts without words are one group.
    Equal rows leave one; texts of any length are compared whole; an empty table stays empty.
    """
    close, far = most_bits(similarity + DOUBT), most_bits(similarity - APART)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = stash(body.mapInArrow(_wide_rows(width), f"doc_id long, h long, node long, size long, {', '.join(f'{w} long' for w in WORDS)}, keys array<long>"))
    nodes = stash(rows.groupBy("node").agg(*(F.min(c).alias(c) for c in ("h", "size", *WORDS, "keys"))))
    rows = rows.select("doc_id", "h", "node")
    blocked, groups = _near_by_blocks(nodes, close, far)
    keyed = nodes.select("node", "size", *WORDS, F.posexplode("keys").alias("t", "k"))
    met = stash(_meetings(keyed, close, far, whole))
    a, b = (nodes.select(F.col("node").alias(k), F.col("h").alias(f"{k}_h")) for k in "ab")

    def verified(pairs: DataFrame) -> DataFrame:
        return stash(_truly_similar(stash(pairs.join(a, "a").join(b, "b").select("a", "b", "a_h", "b_h")), docs, width, similarity))

    pairs = met.where("b is not null").select("a", "b", "bits").unionByName(blocked).distinct()
    tried = pairs.where(F.col("bits") > close).select("a", "b")
    near = pairs.where(F.col("bits") <= close).select("a", "b").unionByName(verified(tried))
    of = components(near, "a", "b")
    apart = met.where("b is null").select(F.col("a").alias("node"), "t", "k").unionByName(groups)
    apart = apart.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    torn = apart.groupBy("t", "k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("t", "k")
    apart = stash(apart.join(torn, ["t", "k"], "left_semi").select("node", "t", "k"))
    if not apart.isEmpty():
        of = components(near.unionByName(_links_apart(apart, nodes, of, docs, width, similarity, close, far, cell)), "a", "b")
    h, k, t, n = free_names(docs, "h", "k", "t", "n")
    keyed = _keyed_by_text(docs, h)
    rows = rows.join(of, "node", "left")
    per = rows.groupBy(F.coalesce("component", "node").alias("root"), "doc_id", "h").agg(F.count("*").alias("n"))
    kept = per.groupBy("root").agg(F.min(F.struct("doc_id", "h", "n")).alias("x")).select(F.col("x.doc_id").alias(k), F.col("x.h").alias(t), F.col("x.n").alias(n))
    stay = keyed.join(kept, keyed["doc_id"].cast("long").eqNullSafe(F.col(k)) & keyed[h].eqNullSafe(F.col(t)))
    return stay.where(F.col(n) == 1).select(*docs.columns).unionByName(stay.where(F.col(n) > 1).dropDuplicates([k, t]).select(*docs.columns))
