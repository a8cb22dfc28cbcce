"""Language identification: known words by per-language log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import batches_of, stash, unit_hash

LONGEST, BACKOFF, UNDETERMINED = 5, math.log(0.4), "und"
BASE = 0x9E3779B97F4A7C15  # of the n-gram hash: a fixed odd number


def letters(word: str) -> str:
    """The word without what isn't a letter at its ends; empty if none is left."""
    if word and word[0].isalpha() and word[-1].isalpha():
        return word
    i, j = 0, len(word)
    while i < j and not word[i].isalpha():
        i += 1
    while j > i and not word[j - 1].isalpha():
        j -= 1
    return word[i:j]


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashes(points: np.ndarray) -> Iterator[np.ndarray]:
    """For n of 1, 2, ... LONGEST: of the n characters that end at each place a hash (of what is there, if they are fewer)."""
    h, power = points.copy(), 1
    yield h
    for back in range(1, LONGEST):
        power = power * BASE % 2**64
        h = h.copy()
        h[back:] += points[:-back] * np.uint64(power)
        yield h


class Model:
    """Log probabilities by language: of words; and of a character after the 4, 3, 2, 1, 0 before it."""

    def __init__(self, langs: list[str], counts: list[tuple[int, str, str, int]]):
        self.langs = langs
        at, width = {x: i for i, x in enumerate(langs)}, len(langs)
        tables: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
        for n, item, lang, c in counts:
            tables[n].setdefault(item, np.zeros(width))[at[lang]] += c
        self.words = {w: i for i, w in enumerate(tables[0])}
        m = np.array(list(tables[0].values())).reshape(len(tables[0]), width)
        self.word_logs = np.log((m + 0.1) / (m.sum(axis=0) + 0.1 * (len(m) + 1))).astype(np.float32)
        m = np.array(list(tables[1].values())).reshape(len(tables[1]), width)
        self.floor = np.log(0.1 / (m.sum(axis=0) + 0.1 * (len(m) + 1))).astype(np.float32)
        self.keys, self.logs = [], []
        for n in range(1, LONGEST + 1):
            names, m = list(tables[n]), np.array(list(tables[n].values())).reshape(len(tables[n]), width)
            if n == 1:
                logs = np.log((m + 0.1) / (m.sum(axis=0) + 0.1 * (len(m) + 1)))
            else:
                before = np.array([tables[n - 1].get(x[:-1], np.zeros(width)) for x in names]).reshape(len(names), width)
                logs = np.log(m / np.maximum(np.maximum(before, m), 1e-30), out=np.full(m.shape, -np.inf), where=m > 0)
            keys = np.zeros(len(names), np.uint64)
            for x in range(n):  # the last character has the weight 1
                keys += np.array([ord(g[n - 1 - x]) for g in names], np.uint64) * np.uint64(pow(BASE, x, 2**64))
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.logs.append(logs[order].astype(np.float32))

    def unseen(self, words: list[str]) -> np.ndarray:
        """Log probability by language of words that no language knows: the product over their characters and their end.

        A character takes the longest context, up to 4 characters, after which a language has it; each shorter one costs
        that language BACKOFF. Languages step down on their own.
        """
        width = len(self.langs)
        if not words:
            return np.zeros((0, width), np.float32)
        points = _points("".join(f"^{w}$" for w in words))
        size = np.array([len(w) + 2 for w in words])
        start = np.cumsum(size) - size
        place = np.arange(len(points)) - np.repeat(start, size)
        out, open_, cost = np.zeros((len(points), width), np.float32), np.repeat((place > 0)[:, None], width, axis=1), np.zeros(len(points), np.float32)
        for n, h in sorted(enumerate(_hashes(points), 1), reverse=True):
            own = np.flatnonzero((place >= max(n - 1, 1)) & open_.any(axis=1))
            if len(own) and len(self.keys[n - 1]):
                i = np.searchsorted(self.keys[n - 1], h[own])
                i[i == len(self.keys[n - 1])] = 0
                hit = self.keys[n - 1][i] == h[own]
                rows, logs = own[hit], self.logs[n - 1][i[hit]]
                fill = open_[rows] & np.isfinite(logs)
                out[rows] += np.where(fill, np.where(fill, logs, 0) + cost[rows][:, None], 0)
                open_[rows] &= ~fill
            if n > 1:
                cost[own] += np.float32(BACKOFF)
        out += np.where(open_, self.floor + cost[:, None], 0)
        return np.add.reduceat(out, start, axis=0)

    def likelihoods(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct words the log probability by language, and whether they have a letter (the others count 0)."""
        cores = [letters(w) for w in words]
        rows = np.array([self.words.get(w, -1) for w in cores], np.int64)
        told = np.array([bool(w) for w in cores], bool)
        out = np.zeros((len(words), len(self.langs)), np.float32)
        known, odd = np.flatnonzero(rows >= 0), np.flatnonzero((rows < 0) & told)
        out[known] = self.word_logs[rows[known]]
        for at in range(0, len(odd), 20_000):
            part = odd[at : at + 20_000]
            out[part] = self.unseen([cores[i] for i in part.tolist()])
        return out, told


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["n", "item", "lang", "c"])

    for batch in batches_of(batches, 0):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, c in Counter(text.lower().split()).items():
                if not (word := letters(word)):
                    continue
                counts[0, word, lang] += c
                for n in range(1, LONGEST + 1):
                    for g in grams(word, n):
                        counts[n, g, lang] += c
            if len(counts) > 200_000:
                yield out()
                counts.clear()
    if counts:
        yield out()


def fit(train: DataFrame, per_lang: int = 600, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from train's text and lang (rows with null in either are left out).

    One bound, a parameter: of each language per_lang documents on average, those whose hash of doc_id and text is low
    enough (all, if there are fewer). All their words and n-grams count. The counts are a distributed aggregation; what comes to the
    driver is the distinct words and n-grams of that sample. Without rows there are no languages.
    """
    rows = train.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    size = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row a language
    share = F.element_at(F.create_map(*(F.lit(x) for k, v in size.items() for x in (k, per_lang / v))), F.col("lang")) if size else F.lit(0.0)
    picked = stash(rows.where(unit_hash(F.col("doc_id").cast("string"), F.xxhash64("text")) < share).select("text", "lang"))
    counts = picked.mapInArrow(_counted, "n int, item string, lang string, c long").groupBy("n", "item", "lang").agg(F.sum("c").alias("c")).toArrow()
    counts = counts.sort_by([(c, "ascending") for c in ("n", "item", "lang")])
    cols = [counts.column(c).to_pylist() for c in ("n", "item", "lang", "c")]
    return Model(sorted(set(cols[2])), list(zip(*cols, strict=True)))


def _scorer(held, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        names = np.array([*model.langs, UNDETERMINED], object)
        width = len(model.langs)
        for piece in batches_of(batches, column, 1 << 12):
            parts = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(piece.column(column), "")))
            ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate(([0], ends[:-1]))
            coded = parts.flatten().dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            logs, told = model.likelihoods(coded.dictionary.to_pylist())
            share = np.exp(logs - logs.max(axis=1, keepdims=True)) if width else logs
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
            share[~told] = 0
            votes, n = (np.stack([_sums(x[:, i][at], starts) for i in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros((len(starts), 0)) for x in (share, told[:, None].astype(np.float32)))
            fine = n[:, 0] > 0 if width else np.zeros(len(starts), bool)
            best = np.where(fine, votes.argmax(axis=1) if width else 0, width)
            score = np.where(fine, votes[np.arange(len(best)), np.minimum(best, width - 1)] / np.maximum(n[:, 0], 1), 0.0) if width else np.zeros(len(best))
            yield piece.append_column("lang told", pa.array(names[best], pa.string())).append_column("score told", pa.array(np.clip(score, 0.0, 1.0)))

    return run


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over texts; every text has a part at least, the empty one."""
    return np.add.reduceat(x.astype(np.float64), starts)


def tell(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with the language of the greatest posterior under equal priors, as the mean over the text's words, and that mean.

    So no single odd word decides, and a text in two languages, or of words that languages share, has a low score however
    long it is. `und` with score 0 if
    the text is null or has no letter (or no language was learned). Ties go to the language that sorts first. Repeated rows
    give repeated rows, an empty table none; texts are taken whole. The two names must be free in docs.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(_scorer(held, docs.columns.index(text)), schema)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): see tell()."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return tell(chosen, model).select("doc_id", "lang_pred", F.col("lang_score").alias("score"))
