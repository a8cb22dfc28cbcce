"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax, trained by distributed updates."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import batches_of, stash, unit_hash

END = b""  # no word is empty
WITHIN, FREQUENT, RARE = 64, 32, 32  # words of a frequent class; frequent and rare classes
COMMON = WITHIN * FREQUENT
CONTEXTS = COMMON + RARE + 1  # a context is a frequent word, a rare class or the start
ROWS_1, ROWS_2 = 1 << 14, 1 << 14  # hashed weight rows of the class layer and the word layer
BLOCKS, GROUPS = 32, 16  # a layer's rows travel in so many blocks, summed in so many groups first
TOP = 1 << 17  # each scorer holds the counts of at most so many words, the most frequent; the others' counts are joined
CHUNK, PIECE = 4096, 8 << 20
SHARE = 8_000_000  # training tokens that give one set of partial sums, or more: the sums are small beside the texts
PRIOR = 3.0  # observations added to what is seen and to what is expected of each feature and class
LOW = np.float32(-1e9)


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of binary texts: the distinct tokens, the tokens' places among them, and where each text's tokens end.

    A-Z are lowered, the six ASCII spaces part words, and each text ends in END. Null counts as empty.
    """
    s = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    s = pc.if_else(pc.equal(pc.binary_length(s), 0), s, pc.binary_join_element_wise(s, pa.scalar(""), " "))  # the last part is END
    parts = pc.ascii_split_whitespace(s)
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary.view(pa.binary()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))


def rare_class(word: bytes) -> int:
    return zlib.crc32(word[:2] + b" " + word[-2:]) % RARE


class Model:
    """Weights and exact corpus counts.

    P(word | context) is P(class | context) * P(word | class, context). The COMMON most frequent tokens make up FREQUENT
    classes by rank; all others, seen or not, fall into RARE classes by their spelling, where they share the mass as
    (c + 0.5) / (N_r + 0.5 * (V_r + 1)), the unseen counting as one. Context features: the word before, the two words
    before as a pair (hashed), and the word two before alone (a skip). Offsets are corpus log shares, so
    untrained weights give the unigram model.
    """

    def __init__(self, n: int, v: int, top: list[tuple[bytes, int]], rare: dict[int, tuple[int, int]]):
        self.n, self.v = n, v
        self.words = pa.array([w for w, _ in top], pa.binary())
        self.counts = np.array([c for _, c in top], np.float64)
        self.symbol = np.array([i if i < COMMON else COMMON + rare_class(w) for i, (w, _) in enumerate(top)] + [0], np.int64)
        common = np.zeros(COMMON)
        common[: min(COMMON, len(top))] = self.counts[:COMMON] + 0.5
        common = common.reshape(FREQUENT, WITHIN)
        left = np.array([rare.get(r, (0, 0)) for r in range(RARE)], np.float64)
        for w, c in top[:COMMON]:
            left[rare_class(w)] -= (c, 1)
        self.rare_mass = left[:, 0] + 0.5 * (left[:, 1] + 1)
        mass = np.concatenate((common.sum(axis=1), self.rare_mass))
        with np.errstate(divide="ignore", invalid="ignore"):
            self.offset_1 = np.where(mass > 0, np.log(mass / mass.sum()), LOW).astype(np.float32)
            self.offset_2 = np.where(common > 0, np.log(common / common.sum(axis=1, keepdims=True)), LOW).astype(np.float32)
        self.w1 = np.zeros((ROWS_1, FREQUENT + RARE), np.float32)
        self.w2 = np.zeros((ROWS_2, WITHIN), np.float32)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of distinct words (-1 outside the top), and their symbols (rank, or COMMON + rare class)."""
        rank = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        symbol = self.symbol[rank]
        outside = np.flatnonzero(rank < 0)
        symbol[outside] = [COMMON + rare_class(w) for w in words.take(pa.array(outside)).to_pylist()]
        return rank, symbol

    def places(self, t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the symbols t of all tokens of some texts: class, place in it (frequent classes), and the weight rows of either layer."""
        begin = np.concatenate(([0], ends[:-1]))
        place = np.arange(len(t)) - np.repeat(begin, ends - begin)
        c = []
        for back in (1, 2):
            before = np.empty_like(t)
            before[back:] = t[:-back]
            before[place < back] = CONTEXTS - 1
            c.append(before)
        cls = np.where(t < COMMON, t // WITHIN, t - COMMON + FREQUENT)
        pair = 2 * CONTEXTS + _hash(c[0] * CONTEXTS + c[1]) % (ROWS_1 - 2 * CONTEXTS)
        rows_1 = np.stack((c[0], CONTEXTS + c[1], pair))
        rows_2 = np.stack([_hash((k * CONTEXTS + c[k]) * FREQUENT + cls) % ROWS_2 for k in (0, 1)])
        return cls, t % WITHIN, rows_1, rows_2

    def log_p(self, cls: np.ndarray, at: np.ndarray, rows_1: np.ndarray, rows_2: np.ndarray) -> np.ndarray:
        """Natural log of the class's and, in frequent classes, the word's probability."""
        out = np.empty(len(cls))
        for lo in range(0, len(cls), CHUNK):
            own = slice(lo, lo + CHUNK)
            x, y = self.layer_1(rows_1[:, own]), cls[own]
            p = x[np.arange(len(y)), y]
            p -= _lse(x)
            f = np.flatnonzero(y < FREQUENT)
            if len(f):
                z = self.layer_2(rows_2[:, own][:, f], y[f])
                p[f] += z[np.arange(len(f)), at[own][f]]
                p[f] -= _lse(z)
            out[own] = p
        return out

    def layer_1(self, rows: np.ndarray) -> np.ndarray:
        x = self.w1[rows[0]]
        for r in rows[1:]:
            x += self.w1[r]
        x += self.offset_1
        return x

    def layer_2(self, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
        x = self.offset_2[cls]
        for r in rows:
            x += self.w2[r]
        return x


def _hash(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((y ^ (y >> np.uint64(32))) >> np.uint64(7)).astype(np.int64)


def _lse(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials, x overwritten; offsets are log shares and weights are small, so none overflows."""
    return np.log(np.exp(x, out=x).sum(axis=1))


def _share(x: np.ndarray) -> np.ndarray:
    np.exp(x, out=x)
    x *= (1 / x.sum(axis=1))[:, None]
    return x


# Counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in batches_of(batches, 0, 1 << 14, PIECE):
        words, at, _ = tokens_of(piece.column(0))
        yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(at, minlength=len(words)))], ["word", "c"])


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word binary, c): counts of every token of column text, by partial counts in each task and a sum by word."""
    return texts.mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _rare_class(word: str) -> Column:
    """rare_class() as a column."""
    w = F.col(word)
    last = F.when(F.octet_length(w) < 2, w).otherwise(F.substring(w, F.octet_length(w) - 1, F.lit(2)))
    return (F.crc32(F.concat(F.substring(w, 1, 2), F.lit(b" "), last)) % RARE).cast("int")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The (word, c) of about the `most` most frequent words; of those tied at the edge, as many as fit, by a hash of the word.

    The least count is found from two small histograms, by the sixteenth of an octave and then within the one at the edge.
    """
    octave = F.floor(F.log2("c") * 16).cast("long")
    room, edge = most, None
    for b, words in sorted(((r[0], r[1]) for r in counts.groupBy(octave).count().collect()), reverse=True):
        if words > room:
            edge = b
            break
        room -= words
    if edge is None:
        return counts
    least, share = None, 0.0
    for c, words in sorted(((r[0], r[1]) for r in counts.where(octave == edge).groupBy("c").count().collect()), reverse=True):
        least, share = c, min(1.0, room / words)
        if words > room:
            break
        room -= words
    return counts.where((F.col("c") > least) | ((F.col("c") == least) & (unit_hash("word") < share)))


# Training


def _expected(into: np.ndarray, rows: np.ndarray, share: np.ndarray) -> None:
    """Add share's rows up by weight row: most have few uses, whose k-th ones are added together."""
    for r in rows.astype(np.uint16 if len(into) <= 1 << 16 else np.int64):
        order = np.argsort(r, kind="stable")
        r, use = r[order], share[order]
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        n = np.diff(np.append(first, len(r)))
        total, live, k = use[first], np.flatnonzero((n > 1) & (n <= 16)), 1
        while len(live):
            total[live] += use[first[live] + k]
            k += 1
            live = live[n[live] > k]
        for i in np.flatnonzero(n > 16):
            total[i] = use[first[i] : first[i] + n[i]].sum(axis=0)
        into[r[first]] += total


def _gathered(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the task's texts show of each weight (its feature and its class together), and what the model expects there."""
        model: Model = held.value
        seen = [np.zeros(w.shape) for w in (model.w1, model.w2)]
        hoped = [np.zeros(w.shape) for w in (model.w1, model.w2)]
        any_ = False
        for piece in batches_of(batches, 0, 1 << 12):
            words, at, ends = tokens_of(piece.column(0))
            cls, place, rows_1, rows_2 = model.places(model.encode(words)[1][at], ends)
            any_ = True
            frequent = cls < FREQUENT
            for total, rows, y in ((seen[0], rows_1, cls), (seen[1], rows_2[:, frequent], place[frequent])):
                for r in rows:
                    total += np.bincount(r * total.shape[1] + y, minlength=total.size).reshape(total.shape)
            for lo in range(0, len(cls), CHUNK):
                own = slice(lo, lo + CHUNK)
                _expected(hoped[0], rows_1[:, own], _share(model.layer_1(rows_1[:, own])))
                f = frequent[own]
                if f.any():
                    r2 = rows_2[:, own][:, f]
                    _expected(hoped[1], r2, _share(model.layer_2(r2, cls[own][f])))
        if any_:
            group = (TaskContext.get().partitionId() if TaskContext.get() else 0) % GROUPS
            rows = [(layer * BLOCKS + k, a.astype(np.float32).tobytes(), b.astype(np.float32).tobytes()) for layer in (0, 1) for k, (a, b) in enumerate(zip(np.split(seen[layer], BLOCKS), np.split(hoped[layer], BLOCKS), strict=True)) if a.any()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([group] * len(rows), pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["block", "part", "seen", "hoped"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for block, part, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            both = np.frombuffer(a, np.float32), np.frombuffer(b, np.float32)
            held = total.setdefault((block, part), [np.zeros(len(x)) for x in both])
            for h, x in zip(held, both, strict=True):
                h += x
    if total:
        keys = list(total)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in (0, 1)), *(pa.array([total[k][i].astype(np.float32).tobytes() for k in keys], pa.binary()) for i in (0, 1))], ["block", "part", "seen", "hoped"])


def updates(train: DataFrame, held, tasks: int) -> list:
    """Rows (block, part, seen, hoped) of all the texts: sums over tasks in groups, then over groups; no task sees all partial sums."""
    kind = "block int, part int, seen binary, hoped binary"
    grouped = train.coalesce(tasks).mapInArrow(_gathered(held), kind).repartition(BLOCKS * GROUPS // 4, "block", "part").mapInArrow(_summed, kind)
    return grouped.withColumn("part", F.lit(0)).repartition(BLOCKS, "block").mapInArrow(_summed, kind).collect()


def step(model: Model, sums: list) -> None:
    """One update: each weight moves by the log of seen to expected, over the features that are on together (iterative scaling)."""
    for block, _, seen, hoped in sums:
        w, on = ((model.w1, 3), (model.w2, 2))[block // BLOCKS]
        k, rows = block % BLOCKS, len(w) // BLOCKS
        a, b = (np.frombuffer(x, np.float32).reshape(rows, -1) + PRIOR for x in (seen, hoped))
        w[k * rows : (k + 1) * rows] += np.log(a / b) / on


def fit(train: DataFrame, doc_id: Column, rounds: int = 3, text: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the count table (word, c) of train.

    Counts cover every token. Updates run in `rounds`: each training text is in one of them by the hash of its id, and
    gives each of its places as a target, so the work grows with the corpus. In a round all tasks look at the same weights;
    what they see and expect is summed over tasks in two levels, and one step is taken, so the model doesn't depend on how
    the texts are dealt to tasks (but for rounding). The driver holds the model alone: about TOP words and 20 MB of sums.
    """
    spark = train.sparkSession
    body = train.select(F.col(text).cast("binary").alias("text"), F.xxhash64(doc_id.cast("string")).alias("h"))
    counts = stash(count_tokens(body.select("text")))
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    top = most_frequent(counts, TOP).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    rare = {r[0]: (r[1], r[2]) for r in counts.groupBy(_rare_class("word")).agg(F.sum("c"), F.count("*")).collect()}
    model = Model(n or 0, v or 0, list(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)), rare)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(model.n / SHARE))
    for r in range(rounds):
        held = spark.sparkContext.broadcast(model)
        step(model, updates(body.where(F.pmod("h", F.lit(rounds)) == r).select("text"), held, tasks))
        held.unpersist()
    return model, counts


# Scoring


def _scored(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        unit = math.log10(model.n + 0.5 * (model.v + 1))
        known = np.log10(model.counts + 0.5) if len(model.counts) else np.zeros(1)
        rare_unit = np.log10(model.rare_mass)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for piece in batches_of(batches, 1, 1 << 12):
            words, at, ends = tokens_of(piece.column(1))
            ranks, symbols = model.encode(words)
            cls, place, rows_1, rows_2 = model.places(symbols[at], ends)
            score = model.log_p(cls, place, rows_1, rows_2) / math.log(10)
            rank = ranks[at]
            own = np.where(rank >= 0, known[np.maximum(rank, 0)], 0.0)
            score += np.where(cls >= FREQUENT, own - rare_unit[np.maximum(cls - FREQUENT, 0)], 0.0)
            m, starts = len(ends), np.concatenate(([0], ends[:-1]))
            sums = [np.add.reduceat(x, starts) for x in ((rank >= 0).astype(np.int64), own - unit, score)]
            outside = np.flatnonzero(rank < 0)
            key, times = np.unique(np.searchsorted(ends, outside, "right") * len(words) + at[outside], return_counts=True)
            cuts = pa.array(np.searchsorted(key // len(words), np.arange(m + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, x) for x in (words.take(pa.array(key % len(words))), pa.array(times.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.arange(row, row + m)), pa.array(ends - starts), *map(pa.array, sums), *lists], ["doc_id", "row", "n_tokens", "n_known", "base", "score", "words", "times"])
            row += m

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of each whole text and its end.

    A null text counts as empty: the end alone. Words beyond the model's TOP get their exact counts by a join. Repeated
    rows give repeated rows, an empty table none; texts of any length are scored whole. Without training texts base_score
    is 0 and each token falls to its class's unseen share.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = body.schema["doc_id"].dataType.simpleString()
    part = stash(body.mapInArrow(_scored(held), f"doc_id {kind}, row long, n_tokens long, n_known long, base double, score double, words array<binary>, times array<int>"))
    rest = part.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rest = rest.join(counts.select("word", "c"), "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5)))).alias("more"))
    out = part.drop("words").withColumn("outside", F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)).join(rest, "row", "left")
    more = F.coalesce("more", F.lit(0.0)) + F.col("outside") * F.log10(F.lit(0.5))  # unseen words have c = 0
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
