"""Benchmark decontamination: a BM25 index of the test items, block-max pruning, verified word overlap."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import batches_of, stash

K1, B = 1.2, 0.75
SHINGLE, SIMILAR = 5, 0.8
THETA = 0.6  # share of an item's own BM25 score that a passage must reach
PART, BLOCK = 128, 2  # words of an item that are indexed together; parts in a block
SENTENCE = re.compile(r"(?<=[.!?])\s+")
MOST_BYTES = 8 << 20  # of items' texts in one broadcast index; more make more indexes, each queried with every passage


def normal(word: str) -> str:
    """Letters and digits between a word's ends; the word itself if it has none."""
    i, j = 0, len(word)
    while i < j and not word[i].isalnum():
        i += 1
    while j > i and not word[j - 1].isalnum():
        j -= 1
    return word[i:j] if i < j else word


def words_of(text: str) -> list[str]:
    return [normal(w) for w in text.lower().split()]


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: the last sentence answers those before it; a single sentence is all question."""
    parts = SENTENCE.split(text.strip())
    return words_of(" ".join(parts[:-1] or parts)), words_of(parts[-1]) if len(parts) > 1 else []


def shingles(words: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    """Word shingles; all the words as one if they are fewer."""
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def contained(own: set[tuple[str, ...]], near: list[str]) -> float:
    """The share of own that is in the words near; 1 if there is none."""
    return len(own & shingles(near, len(next(iter(own))))) / len(own) if own else 1.0


def pieces_of(text: str) -> list[list[str]]:
    """The words of an item in parts of PART; a short rest is filled up from the words before it."""
    question, answer = split_item(text)
    words, out = question + answer, []
    for at in range(0, len(words), PART):
        piece = words[at : at + PART]
        out.append(words[-PART:] if at and len(piece) < PART // 2 else piece)
    return out


@dataclass
class Corpus:
    """What BM25 needs to know of all the items: parts, their mean words, and in how many parts each term is."""

    parts: int
    mean: float
    df: dict[str, int]


class Index:
    """Postings of item parts with impacts scaled so that a part scores 1 against itself, and block maxima of them."""

    def __init__(self, items: list[tuple[int, str]], corpus: Corpus | None = None):
        """corpus: the statistics of all items, if these are a share of them."""
        self.items, self.qa, parts, self.owner = [], [], [], []
        for item, text in items:
            question, answer = split_item(text)
            if pieces := pieces_of(text):
                self.items.append(item)
                self.qa.append((shingles(question + answer), shingles(question), shingles(answer)))
                parts += map(Counter, pieces)
                self.owner += [len(self.items) - 1] * len(pieces)
        n = len(parts)
        corpus = corpus or Corpus(n, sum(map(Counter.total, parts)) / max(n, 1), Counter(t for p in parts for t in p))
        self.terms = {t: i for i, t in enumerate(sorted({t for p in parts for t in p}))}
        idf = {t: math.log(1 + (corpus.parts - corpus.df[t] + 0.5) / (corpus.df[t] + 0.5)) for t in self.terms}
        own = []
        for p in parts:
            norm = K1 * (1 - B + B * p.total() / corpus.mean)
            raw = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in p.items()}
            total = sum(raw.values())
            own.append({t: x / total for t, x in raw.items()})
        order = sorted(range(n), key=lambda i: (max(own[i].values()), i))  # blocks of parts with like impacts
        self.owner = [self.owner[i] for i in order]
        rows = sorted((self.terms[t], k, x) for k, i in enumerate(order) for t, x in own[i].items())
        self.part, self.impact = [r[1] for r in rows], [r[2] for r in rows]
        self.start = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(len(self.terms) + 1)).tolist()
        best: dict[tuple[int, int], float] = {}
        for t, p, x in rows:
            best[t, p // BLOCK] = max(x, best.get((t, p // BLOCK), 0.0))
        self.block_max = best
        flat = sorted(best)
        self.block, self.block_top = np.array([k[1] for k in flat], np.int64), np.array([best[k] for k in flat])
        self.block_start = np.searchsorted(np.array([k[0] for k in flat], np.int64), np.arange(len(self.terms) + 1))
        self.blocks = -(-n // BLOCK)
        self.top = np.array([max(self.impact[a:b]) for a, b in zip(self.start[:-1], self.start[1:], strict=True)])

    def possible(self, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Which of n passages, from distinct (passage, term) pairs sorted by passage, could hold a pivot at all.

        First by the sum of the terms' largest impacts, then by the sum of the block maxima in each block, for batches of
        passages whose blocks fit 4,000,000 sums.
        """
        slack, out = THETA - 1e-9, []
        alive = np.bincount(passage, self.top[term], n) >= slack
        passage, term = passage[alive[passage]], term[alive[passage]]
        name, passage = np.unique(passage, return_inverse=True)
        step = max(1, 4_000_000 // max(self.blocks, 1))
        for lo in range(0, len(name), step):
            own = slice(*np.searchsorted(passage, (lo, lo + step)))
            p, t = passage[own] - lo, term[own]
            size = self.block_start[t + 1] - self.block_start[t]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.block_start[t], size)
            m = min(step, len(name) - lo)
            bound = np.bincount(np.repeat(p, size) * self.blocks + self.block[at], self.block_top[at], m * self.blocks)
            out.append(name[lo + np.flatnonzero((bound.reshape(m, -1) >= slack).any(axis=1))])
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def above(self, terms: list[int]) -> list[tuple[int, float]]:
        """(part, score >= THETA) for a passage's distinct terms, by block-max WAND: all of them, not the best few.

        Cursors stand on their postings in part order. The pivot is the first part that the terms' largest impacts could lift
        to THETA; if the block maxima around it could too, it is scored once all cursors before it have come up, else the
        cursors skip the rest of the block.
        """
        slack, part, top, found = THETA - 1e-9, self.part, self.top, []
        cursors = [[part[self.start[t]], self.start[t], self.start[t + 1], t, float(top[t])] for t in terms]

        def seek(moved: list[list], least: int) -> None:
            for c in moved:
                c[1] = bisect_left(part, least, c[1], c[2])
                c[0] = part[c[1]] if c[1] < c[2] else -1

        while cursors:
            cursors.sort(key=itemgetter(0))
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[4]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            block = at // BLOCK
            if sum(self.block_max.get((c[3], block), 0.0) for c in cursors[: pivot + 1]) < slack:
                skip = (block + 1) * BLOCK
                seek(cursors[: pivot + 1], min(skip, cursors[pivot + 1][0]) if pivot + 1 < len(cursors) else skip)
            elif cursors[0][0] == at:
                score = sum(self.impact[c[1]] for c in cursors[: pivot + 1])
                if score >= slack:
                    found.append((at, score))
                seek(cursors[: pivot + 1], at + 1)
            else:
                seek([c for c in cursors[: pivot + 1] if c[0] < at], at)
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def search(self, texts: list[str]) -> list[list[tuple[int, float, float, float, float]]]:
        """Of each text, (item, score, overlap, question overlap, answer overlap) of the verified items, best passage each."""
        get, owner, terms, spans, found = self.terms.get, [], [], [], [{} for _ in texts]
        cache: dict[str, int] = {}
        for k, text in enumerate(texts):
            words = text.lower().split()
            ids = np.empty(len(words), np.int64)
            for at in range(0, len(words), 1 << 15):
                part = words[at : at + (1 << 15)]
                for w in set(part).difference(cache):
                    cache[w] = get(normal(w), -1)
                ids[at : at + len(part)] = [cache[w] for w in part]
                if len(cache) > 400_000:
                    cache.clear()
            for at in range(0, max(1, len(words) - PART), PART):  # windows of two parts, a part apart: a part lies whole in one
                own = ids[at : at + 2 * PART]
                own = np.unique(own[own >= 0])
                owner.append(np.full(len(own), len(spans)))
                terms.append(own)
                spans.append((k, at, words))
        if not spans or not len(self.top):
            return [[] for _ in texts]
        passage, term = np.concatenate(owner), np.concatenate(terms)
        open_ = self.possible(passage, term, len(spans))
        ends = np.searchsorted(passage, np.arange(len(spans) + 1))
        for s in open_.tolist():
            k, at, words = spans[s]
            for part, score in self.above(term[ends[s] : ends[s + 1]].tolist()):
                item = self.owner[part]
                wide = max(2 * PART, 2 * len(self.qa[item][0]))
                near = [normal(w) for w in words[max(0, at - wide) : at + 2 * PART + wide]]
                whole, question, answer = (contained(x, near) for x in self.qa[item])
                if whole >= SIMILAR or (question >= SIMILAR and answer >= SIMILAR):
                    found[k][item] = max(found[k].get(item, (0.0,) * 4), (score, whole, question, answer))
        return [[(self.items[i], *v) for i, v in sorted(f.items())] for f in found]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of items (share, text): in how many parts a term is (term, n), and one row (null, words, parts) a share."""
    counts: dict[int, Counter] = {}
    words, parts = Counter(), Counter()
    for batch in batches_of(batches, 1):
        for share, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for piece in pieces_of(text):
                counts.setdefault(share, Counter()).update(set(piece))
                words[share] += len(piece)
                parts[share] += 1
    for share, c in counts.items():
        names, n = [*c, None], [*c.values(), words[share]]
        yield pa.RecordBatch.from_arrays([pa.array([share] * len(n), pa.int32()), pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array([0] * len(c) + [parts[share]], pa.int64())], ["share", "term", "n", "parts"])


def _indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", most: int = MOST_BYTES) -> tuple[list, T.DataType]:
    """Broadcast indexes that hold the distinct items with a text, at most about `most` bytes of it each; and the id's type.

    Their statistics are those of all the items, so how many indexes there are changes no score.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()
    shares = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / most))
    items = stash(items.withColumn("share", F.pmod(F.xxhash64("text"), F.lit(shares)).cast("int")))
    terms = stash(items.select("share", "text").mapInArrow(_terms, "share int, term string, n long, parts long"))
    total = terms.where("term is null").agg(F.sum("n"), F.sum("parts")).first()
    df = terms.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    held = []
    for k in range(shares):
        rows = items.where(F.col("share") == k).orderBy("item_id", "text").collect()
        own = terms.where((F.col("share") == k) & F.col("term").isNotNull()).select("term").distinct()
        corpus = Corpus(total[1] or 0, (total[0] or 0) / max(total[1] or 0, 1), {r.term: r.df for r in df.join(own, "term").collect()})
        held.append(benchmark.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in rows], corpus)))
    return held, items.schema["item_id"].dataType


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", most: int = MOST_BYTES) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap): a row for each document and item it leaks.

    Every passage (256 words, 128 apart) of every text is a query. All items whose BM25 score reaches THETA of their own
    score are retrieved, then verified on word 5-grams around the passage: 0.8 of the item's, or 0.8 of its question's and
    of its answer's. The passage of the highest score gives the row. Case, spacing and punctuation at word ends don't count.
    Null, empty and blank texts and items match nothing. Repeated documents give repeated rows; a repeated item counts once.
    The index is broadcast; it holds about `most` bytes of items, and a larger benchmark is searched index by index, with
    the same scores.
    """
    indexes, item_kind = _indexes(benchmark, item_id, text, most)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ("score", "overlap", "question_overlap", "answer_overlap")
    fields = T.StructType([T.StructField("doc_id", chosen.schema[0].dataType), T.StructField("item_id", item_kind), *(T.StructField(c, T.DoubleType()) for c in names)])
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])

    def searched(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in batches_of(batches, 1, 64):
                hits = held.value.search([t or "" for t in piece.column(1).to_pylist()])
                rows = [(i, *h) for i, of in zip(piece.column(0).to_pylist(), hits, strict=True) for h in of]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        return chosen.mapInArrow(run, fields)

    return reduce(DataFrame.unionByName, map(searched, indexes))


def clean(docs: DataFrame, benchmark: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """docs without the rows that leak an item; all columns kept. Each row is judged by its own text, whatever its id.

    Null and empty texts leak nothing and stay; repeated rows share one fate; an empty table stays empty.
    """
    def kept(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in batches_of(batches, "text", 64):
                yield piece.filter(pa.array([not hits for hits in held.value.search([t or "" for t in piece.column("text").to_pylist()])], pa.bool_()))

        return run

    out = docs
    for held in _indexes(benchmark, most=most)[0]:
        out = out.mapInArrow(kept(held), docs.schema)
    return out
