"""Token counts by rank-synchronous array merging of batched pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import batches_of

MARK = "▁"
PIECE = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHE, LONG = 400_000, 1 << 20
NONE = np.iinfo(np.int64).max
#: Text that no normaliser but the identity leaves alone: repeated and outer spaces, a ligature, full width, a combining accent.
PROBE = "  a  ﬁ Ａ é\tＢ b  "


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of each wanted value its place in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    i = np.searchsorted(keys, wanted)
    i[i == len(keys)] = 0
    return np.where(keys[i] == wanted, i, -1)


class Merges:
    """A piece vocabulary as arrays: code points to symbols, and symbol pairs to the symbol and rank of their merge."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(MARK in p.lstrip(MARK) for p in pieces) or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("pre-tokens end before a space: no piece may hold one after another character")
        if sp.normalize(PROBE) != MARK + PROBE.replace(" ", MARK):
            raise ValueError("texts must be taken as they are, with one space put before them")
        chars = sorted((ord(p), i) for p, i in pieces.items() if len(p) == 1)
        self.point, self.symbol = (np.array(c, np.int64) for c in zip(*chars, strict=True)) if chars else (np.empty(0, np.int64),) * 2
        score = np.array([sp.get_score(i) for i in range(n)])
        order = np.lexsort((np.arange(n), -score))  # rank 0: the highest score
        level = np.concatenate(([0], np.cumsum(np.diff(score[order]) != 0)))  # equal scores share a rank
        rank = np.empty(n, np.int64)
        rank[order] = level
        self.n = n + 1  # symbol n: a character the vocabulary lacks, which its bytes replace in the end
        found, inside = {}, set()
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                inside.add((ord(p[cut - 1]) << 21) + ord(p[cut]))
                a, b = pieces.get(p[:cut]), pieces.get(p[cut:])
                if a is not None and b is not None:
                    found[a * self.n + b] = (int(rank[i]), i)
        keys = sorted(found)
        self.keys = np.array(keys, np.int64)
        self.rank = np.array([found[k][0] for k in keys], np.int64)
        self.into = np.array([found[k][1] for k in keys], np.int64)
        self.inside = np.array(sorted(inside), np.int64)  # pairs of code points that some piece holds side by side

    def counts(self, words: list[str]) -> list[int]:
        """Symbols left of each word after all merges; unknown characters count as their UTF-8 bytes."""
        out: list[int] = []
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= 200_000):
                size += len(words[end])
                end += 1
            out += self._together(words[at:end])
            at = end
        return out

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of the merges of a and b; rank NONE where there is none."""
        i = _find(self.keys, a * self.n + b)
        return np.where(i >= 0, self.rank[i], NONE), np.where(i >= 0, self.into[i], -1)

    def _together(self, words: list[str]) -> list[int]:
        """All sequences in one ragged array; each round merges every sequence's lowest-rank pair.

        All its occurrences merge at once, left to right without overlap, up to one that makes a pair which comes before the
        next occurrence: the same order as one merge at a time. Between characters that no piece holds side by side nothing
        ever merges, so a sequence is cut there.
        """
        point = _points("".join(words))
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        i = _find(self.point, point)
        sym = np.where(i >= 0, self.symbol[i] if len(self.symbol) else 0, self.n - 1)
        odd = np.flatnonzero(i < 0)
        more = (point[odd] >= 0x80).astype(np.int64) + (point[odd] >= 0x800) + (point[odd] >= 0x10000)
        final = np.bincount(word[odd], more, len(words)).astype(np.int64)
        cut = (word[1:] != word[:-1]) | (_find(self.inside, (point[:-1] << 21) + point[1:]) < 0)
        seq = np.concatenate(([0], np.cumsum(cut))) if len(word) else word
        owner = word[np.concatenate(([True], cut))] if len(word) else word
        rank, into = np.full(len(sym), NONE), np.full(len(sym), -1)
        if len(sym) > 1:
            joined = np.flatnonzero(~cut)
            rank[joined], into[joined] = self._pair(sym[joined], sym[joined + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            size = np.diff(np.append(first, len(seq)))
            best = np.minimum.reduceat(rank, first)
            if (done := best == NONE).any():
                final += np.bincount(owner[seq[first[done]]], size[done], len(words)).astype(np.int64)
                stay = np.repeat(~done, size)
                sym, seq, rank, into = sym[stay], seq[stay], rank[stay], into[stay]
                best, size = best[~done], size[~done]
                if not len(sym):
                    break
            lowest = np.repeat(best, size)
            at = np.flatnonzero(rank == lowest)
            start = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
            at = at[(np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 0]
            new, low = into[at], lowest[at]
            prior = np.concatenate(([False], np.diff(at) == 2))  # the occurrence before ends where this one begins
            left = np.where(prior, np.concatenate(([0], new[:-1])), sym[np.maximum(at - 1, 0)])
            left_of = (at > 0) & (seq[np.maximum(at - 1, 0)] == seq[at])
            after = np.minimum(at + 2, len(sym) - 1)
            right_of = (at + 2 < len(sym)) & (seq[after] == seq[at])
            sooner = (left_of & (self._pair(left, new)[0] <= low)) | (right_of & (self._pair(new, sym[after])[0] <= low))
            if sooner.any():
                upto, head = np.cumsum(sooner) - sooner, np.concatenate(([True], seq[at[1:]] != seq[at[:-1]]))
                keep = upto == upto[np.flatnonzero(head)][np.cumsum(head) - 1]
                at, new = at[keep], new[keep]
            sym[at] = new
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))
            sym, seq, rank, into = sym[stay], seq[stay], rank[stay], into[stay]
            fresh = np.concatenate((at, at[at > 0] - 1))
            rank[fresh] = NONE
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[seq[fresh] == seq[fresh + 1]]
            rank[fresh], into[fresh] = self._pair(sym[fresh], sym[fresh + 1])
        return final.tolist()


_LOADED: dict[str, tuple[Merges, dict[str, int]]] = {}


def _parts(text: str) -> Iterator[list[str]]:
    """A text's pre-tokens; of a very long one, so many at a time."""
    marked = MARK + text.replace(" ", MARK)
    if len(marked) <= LONG:
        yield PIECE.findall(marked)
        return
    found = (m.group() for m in PIECE.finditer(marked))
    while part := list(islice(found, 1 << 16)):
        yield part


def count_batch(texts: list[str | None], merges: Merges, known: dict[str, int]) -> list[int]:
    """Tokens of each text. known: counts by pre-token, kept over batches and emptied when it is large."""
    out, waiting, size = [0] * len(texts), [], 0

    def settle() -> None:
        missing = set().union(*(p for _, p in waiting)).difference(known)
        if missing and len(known) > CACHE:
            known.clear()
            missing = set().union(*(p for _, p in waiting))
        fresh = list(missing)
        known.update(zip(fresh, merges.counts(fresh), strict=True))
        for i, part in waiting:
            out[i] += sum(map(known.__getitem__, part))

    for i, text in enumerate(texts):
        for part in _parts(text) if text else ():
            waiting.append((i, part))
            size += len(part)
            if size > 1 << 18:
                settle()
                waiting, size = [], 0
    if waiting:
        settle()
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) by the BPE piece model at `path`, a file that each executor has.

    A null text counts as empty: 0 bytes, 0 tokens. Texts of any length go by the same merging. Repeated rows give repeated
    rows, an empty table none.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = (Merges(path), {})
        merges, known = _LOADED[path]
        for batch in batches_of(batches, 1):
            texts = batch.column(1).to_pylist()
            n = np.array(count_batch(texts, merges, known), np.int64)
            size = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return chosen.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
