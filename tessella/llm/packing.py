"""Packing token sequences: cost-balanced, descending documents into the sequence of the lowest cost with room."""

from __future__ import annotations

import heapq
import json
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import batches_of

LINEAR, QUADRATIC = 1.0, 1.0 / 1024  # estimated cost of a piece: of its tokens, and of its attention, the tokens squared
GROUP = 8192  # documents packed together, on average
WORDS, LONG, WINDOW = 400_000, 1000, 4 << 20  # words whose ids a task keeps; bytes of a word that it doesn't keep; of a text that it splits at once
LATIN = "\u0250"  # characters before it are lower-cased and composed alike everywhere
SPACE = re.compile(rb"[\x20\x09-\x0D]")
PROBE = " It's\t\tA  line's\n<|endoftext|> of\x0b\x0c\r odd-things, É é ́x ΑΣ Σ 12 3'll 日本 <|startoftext|>x \x00"


class Words:
    """Ids by the tokenizer at `path`, as little-endian 32-bit bytes; those of known words from memory.

    A tokenizer that gives for a text what it gives for its words is asked for words alone; that is probed, and any other gets
    whole texts. Where its file says that it lower-cases, splits by a pattern and merges byte symbols in the order of their
    ids, words of Latin letters are split by that pattern and merged by the same table as ranks of bytes, many in a call, a space
    standing for the end of a word; all others go through the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        if self.tokenizer.truncation or self.tokenizer.padding:
            raise ValueError("the tokenizer must neither truncate nor pad")
        said = json.loads(self.tokenizer.to_str())
        self.marks = {x["content"][0] for x in said["added_tokens"]}  # a word that holds one may hold a special token
        self.pattern = self.merges = None
        ranks, pattern = _byte_ranks(said), _pattern(said)
        if ranks and pattern:
            import tiktoken

            self.pattern = regex.compile(f"(?:{pattern})|\n")
            self.merges = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
            self.line = ranks[b"\n "]
        probe = PROBE.encode()
        whole = self.encoded(PROBE)
        self.by_words = whole == b"".join(self.encoded(w.decode()) for w in probe.split())
        if self.by_words and self.ids([probe])[0] != whole:
            raise ValueError("the tokenizer's parts don't give what it gives")

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of whole texts; none for a null."""
        if not self.by_words:
            return [self.encoded(t.decode(errors="replace")) if t else b"" for t in texts]
        if all(t is None or len(t) <= WINDOW for t in texts):
            return self._of([t.split() if t else [] for t in texts])
        return [b"".join(self._of([part.split()])[0] for part in _windows(t)) if t else b"" for t in texts]

    def _of(self, split: list[list[bytes]]) -> list[bytes]:
        every = set().union(*split)
        fresh = list(every.difference(self.known))
        if len(self.known) + len(fresh) > WORDS:
            self.known.clear()
            fresh = list(every)
        self._learn(fresh)
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for w in fresh:
            if len(w) > LONG:
                del self.known[w]
        return out

    def _learn(self, words: list[bytes]) -> None:
        latin = lambda text: max(text, default="") < LATIN and self.marks.isdisjoint(text)
        text = b"\n".join(words).decode(errors="replace")
        if self.merges is None or not latin(text):
            fine = [w for w in words if self.merges is not None and latin(w.decode(errors="replace"))]
            for w in set(words).difference(fine):
                self.known[w] = self.encoded(w.decode(errors="replace"))
            words, text = fine, b"\n".join(fine).decode()
        if words:
            pieces = self.pattern.findall(unicodedata.normalize("NFC", text).lower() + "\n")  # a line break, which no word holds, is a piece too
            ids = np.array(self.merges.encode_ordinary(" ".join([*pieces, ""])), "<u4")
            ends = np.flatnonzero(ids == self.line).tolist()
            data = ids.tobytes()
            self.known.update(zip(words, [data[4 * a + 4 : 4 * b] for a, b in zip([-1, *ends[:-1]], ends, strict=True)], strict=True))


def _pattern(said: dict) -> str | None:
    """The pattern of a tokenizer that composes, lower-cases, keeps what the pattern finds, and maps bytes to symbols."""
    stages = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
    split, *rest = (said["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    plain = stages == ["NFC", "Replace", "Lowercase"] and split.get("invert") and split.get("behavior") == "Removed" and rest == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    return split.get("pattern", {}).get("Regex") if plain else None


def _byte_ranks(said: dict) -> dict[bytes, int] | None:
    """A byte-level vocabulary with ends of words as ranks of bytes, a space for the end; None if its merges aren't in the order of their ids."""
    from tokenizers import pre_tokenizers

    model, suffix = said["model"], said["model"].get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix or model.get("dropout") or model.get("continuing_subword_prefix"):
        return None
    shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    of = {}
    for c in map(chr, range(256)):  # characters of one byte, and of two, whose symbols stand for their bytes in turn
        of.update(zip(shown(c)[0][0], c.encode(), strict=True))
    of.update(zip((s for c in map(chr, range(0x100, 0x800)) for s in shown(c)[0][0]), (b for c in map(chr, range(0x100, 0x800)) for b in c.encode()), strict=True))
    for c in (chr(0x800), chr(0xFFFD), *(chr(k << 12) for k in range(1, 16) if k != 13), chr(0x10000), chr(0x40000), chr(0x80000), chr(0xC0000), chr(0x100000)):
        of.update(zip(shown(c)[0][0], c.encode(), strict=True))
    special = {x["content"] for x in said["added_tokens"]}
    ranks = {}
    for token, i in model["vocab"].items():
        if token not in special:
            body, end = (token[: -len(suffix)], b" ") if token.endswith(suffix) and token != suffix else (token, b"")
            if any(c not in of for c in body):
                continue  # bytes that no text has
            ranks[bytes(of[c] for c in body) + end] = i
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    whole = made == sorted(made) and all(bytes([b]) in ranks and bytes([b, 32]) in ranks for b in of.values())
    return ranks if whole else None


def _windows(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at white space."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + WINDOW)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def capacities(tokens: int, length: int) -> list[int]:
    """Sequences that hold exactly so many tokens: full ones, and for the rest its powers of two, which take no padding."""
    return [length] * (tokens // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if (tokens % length) >> b & 1]


def balanced(sizes: np.ndarray, length: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (item, start, size, sequence) of items of `sizes` tokens, each at most `length`, in sequences of exactly their capacities.

    Items go in descending order, each whole into the sequence of the lowest cost among those with room for it (ties to
    the first). Where none has, the emptiest takes as much as fits, and the rest waits for its turn as a shorter item.
    """
    sizes = np.asarray(sizes, np.int64)
    room = capacities(int(sizes.sum()), length)
    order = np.argsort(-sizes, kind="stable")
    waiting: list[list[int]] = [[] for _ in range(length + 1)]  # by their room: sequences that lack room for the present size
    for s in reversed(range(len(room))):
        waiting[room[s]].append(s)
    cost = [0.0] * len(room)
    open_: list[tuple[float, int]] = []  # sequences with room for the present size, by cost
    cut: list[tuple[int, int, int]] = []  # rests (-size, item, start)
    out: list[tuple[int, int, int, int]] = []
    level, at, n = length + 1, 0, len(sizes)
    while at < n or cut:
        if cut and (at == n or -cut[0][0] > sizes[order[at]]):
            size, item, start = heapq.heappop(cut)
            size = -size
        else:
            item, start = int(order[at]), 0
            size = int(sizes[item])
            at += 1
        if not size:
            continue
        while level > size:
            level -= 1
            for s in waiting[level]:
                heapq.heappush(open_, (cost[s], s))
            waiting[level] = []
        while open_ and room[open_[0][1]] < size:
            s = heapq.heappop(open_)[1]
            waiting[room[s]].append(s)
        if open_:
            s, takes = heapq.heappop(open_)[1], size
        else:
            takes = size - 1
            while not waiting[takes]:
                takes -= 1
            s = waiting[takes].pop()
            heapq.heappush(cut, (takes - size, item, start + takes))
        out.append((item, start, takes, s))
        room[s] -= takes
        cost[s] += linear * takes + quadratic * takes * takes
        if room[s] >= level:
            heapq.heappush(open_, (cost[s], s))
        elif room[s]:
            waiting[room[s]].append(s)
    return tuple(np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4  # type: ignore[return-value]


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, length: int = 2048, end: int | None = 1, group: int = GROUP, linear: float = LINEAR, quadratic: float = QUADRATIC, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all documents in sequences of `length`, a power of two.

    A document is its text's ids by the tokenizer at `path`, a file that each executor has, and the id `end`. Every `length` of
    its ids from the start fill a sequence; what is left is packed with others by cost. The documents are dealt at random into
    groups of bounded size, each packed in a task; a group's sequences are full but for at most log2(length) ones whose
    lengths are powers of two, so that no sequence needs padding. ids_crc32: of the ids as little-endian 32-bit words;
    offset: the piece's place in its sequence; sequence ids are unique, not consecutive. keep_ids adds the ids.

    A null text counts as empty: `end` alone. Texts of any length go in whole. Each row is a document, also where ids or
    whole rows repeat. An empty table gives no rows; without `end`, a text without tokens gives none.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    groups = max(1, math.ceil(chosen.count() / group))

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Words(path)
        for batch in batches_of(batches, 1):
            n, tails, full = [], [], []
            for data in _LOADED[path].ids(batch.column(1).cast(pa.binary()).to_pylist()):
                ids = np.frombuffer(data if end is None else data + np.array([end], "<u4").tobytes(), "<u4")
                n.append(len(ids))
                tails.append(ids[len(ids) // length * length :].tobytes())
                blocks = [ids[k : k + length].tobytes() for k in range(0, len(ids) // length * length, length)]
                full.append(b"".join(blocks) if keep_ids else np.array([zlib.crc32(v) for v in blocks], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(tails, pa.binary()), pa.array(full, pa.binary())], ["doc_id", "part", "n", "tail", "full"])

    def packed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One group: full blocks first, then the tails by cost."""
        table = pa.Table.from_batches(list(batches))
        n, tails, full = table["n"].to_numpy(), table["tail"].to_pylist(), table["full"].to_pylist()
        blocks = n // length
        rest = n - blocks * length
        item, start, size, sequence = balanced(rest, length, linear, quadratic)
        order = np.lexsort((np.arange(len(item)), sequence))
        item, start, size, sequence = (c[order] for c in (item, start, size, sequence))
        upto = np.cumsum(size) - size
        first = np.flatnonzero(np.concatenate(([True], sequence[1:] != sequence[:-1]))) if len(item) else np.empty(0, np.int64)
        offset = upto - np.repeat(upto[first], np.diff(np.append(first, len(item))))
        ids = [tails[i][4 * a : 4 * (a + k)] for i, a, k in zip(item.tolist(), start.tolist(), size.tolist(), strict=True)]
        whole = np.repeat(np.arange(len(n)), blocks)
        nth = np.arange(len(whole)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        if keep_ids:
            held = [full[i][4 * length * k : 4 * length * (k + 1)] for i, k in zip(whole.tolist(), nth.tolist(), strict=True)]
            crc_whole = np.array([zlib.crc32(v) for v in held], np.int64)
        else:
            crc_whole = np.frombuffer(b"".join(full), "<u4").astype(np.int64)
        item_all = np.concatenate((whole, item))
        base = int(key[0].as_py() if hasattr(key[0], "as_py") else key[0]) << 40
        columns = {
            "doc_id": table["doc_id"].combine_chunks().take(pa.array(item_all)),
            "start": np.concatenate((nth * length, start + blocks[item] * length)),
            "length": np.concatenate((np.full(len(whole), length), size)),
            "ids_crc32": np.concatenate((crc_whole, np.array([zlib.crc32(v) for v in ids], np.int64))),
            "doc_tokens": n[item_all],
            "sequence_id": base + np.concatenate((np.arange(len(whole)), len(whole) + sequence)),
            "offset": np.concatenate((np.zeros(len(whole), np.int64), offset)),
        }
        if keep_ids:
            columns["ids"] = pa.array([np.frombuffer(v, "<u4").astype(np.int64) for v in [*held, *ids]], pa.list_(pa.int64()))
        out = pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, pa.int64()) for c in columns.values()], list(columns))
        for at in range(0, out.num_rows, 10_000):
            yield out.slice(at, 10_000)

    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("part")
    dealt = chosen.select("doc_id", "text", part).mapInArrow(tokenized, f"doc_id {kind}, part long, n long, tail binary, full binary")
    return dealt.groupBy("part").applyInArrow(packed, f"doc_id {kind}, {PIECES}" + (", ids array<long>" if keep_ids else ""))


_LOADED: dict[str, Words] = {}
