"""SentencePiece encoding and decoding from a model file, without the library.

An Aho-Corasick automaton over the pieces reads a segment once; at each position the output links give
every piece that ends there, and the position's best way to get there is relaxed over them (Viterbi).

* Unigram models: the way with the highest sum of scores, as it stands.
* BPE models: the sum of scores isn't what merging yields. There the way to a position is valid if its
  last two pieces, merged from scratch, stay these two pieces; exactly one way is, and relaxation keeps
  it. Pairs are tried once and remembered.

Texts are cut at spaces first where no piece reaches across one, and the ids of a word are kept.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._memory import lean

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
KEEP = 300_000
PAIRS = 500_000
LONGEST = 64


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        out |= (c & 127) << shift
        i, shift = i + 1, shift + 7
        if c < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            v, i = b[i : i + n], i + n
        yield key >> 3, v


class Model:
    """Pieces, scores and types of a model file, with identity normalisation."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.bpe, self.prefix = False, True
        trim, rules = True, b""
        for f, v in _fields(raw):
            if f == 1:
                x = dict(_fields(v))
                self.pieces.append(x.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.types.append(x.get(3, NORMAL))
            elif f == 2:
                self.bpe = dict(_fields(v)).get(3, 1) == 2
            elif f == 3:
                x = dict(_fields(v))
                rules, self.prefix, trim = x.get(2, b""), bool(x.get(3, 1)), bool(x.get(4, 1))
        if rules or trim:
            raise ValueError("only models with identity normalisation are read")
        self.dtype = np.dtype("<u2" if len(self.pieces) <= 1 << 16 else "<u4")
        self.normal = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER)}
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.normal.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.signs = {p for p in self.normal if len(p) == 1}
        self.separable = all(MARK not in p.lstrip(MARK) for p in self.normal)
        self.table = [bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        #: No piece reaches across a line's end: a word is cut there, and its lines are kept apart.
        self.by_line = 10 in self.bytes and not any("\n" in p for p in self.normal)
        self.raw = [np.array([i], self.dtype).tobytes() for i in range(len(self.pieces))]
        self.words: dict[str, bytes] = {}
        self.lines: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.runs: dict[int, list[int]] = {}

    # -- encoding

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian."""
        if not text:
            return b""
        text = text.replace(MARK, " ")
        if not self.separable or not self.prefix:
            return self._ids(self._segment((MARK if self.prefix else "") + text.replace(" ", MARK)))
        words = text.split(" ")
        if len(self.words) > KEEP:  # the first ones met are the commonest
            self.words = dict(islice(self.words.items(), KEEP // 6))
        if len(self.lines) > KEEP // 4:
            self.lines.clear()
        known = self.words
        if "" not in words:
            try:
                return b"".join(map(known.__getitem__, words))
            except KeyError:
                return b"".join([known[w] if w in known else self._word(w) for w in words])
        out, spaces = [], 0
        for w in words:
            if not w:
                spaces += 1
                continue
            ids = known[w] if w in known else self._word(w)
            if spaces:
                alone = ids[: self.dtype.itemsize] == self._ids([self.normal[MARK]]) if MARK in self.normal else False
                out.append(self._ids(self._run(spaces + alone)))
                ids = ids[self.dtype.itemsize :] if alone else ids
                spaces = 0
            out.append(ids)
        if spaces:
            out.append(self._ids(self._run(spaces)))
        return b"".join(out)

    def _ids(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def _word(self, word: str) -> bytes:
        if self.by_line and "\n" in word:
            first, *rest = word.split("\n")
            ids = (self.words.get(first) or self._word(first)) if first else self._ids(self._segment(MARK))
            ids += b"".join([self.raw[self.bytes[10]] + (self.lines.get(x) or self._line(x)) if x else self.raw[self.bytes[10]] for x in rest])
        else:
            ids = self._ids(self._segment(MARK + word))
        if len(word) <= LONGEST:
            self.words[word] = ids
        return ids

    def _line(self, rest: str) -> bytes:
        """What stands in a word after a line's end."""
        ids = self._ids(self._segment(rest))
        if len(rest) <= LONGEST:
            self.lines[rest] = ids
        return ids

    def _segment(self, s: str) -> list[int]:
        """One pass of the automaton over a segment, with a relaxation at each position."""
        n = len(s)
        if self.bpe and self.signs.issuperset(s):
            return self._merged(s, n)
        score, piece, start = [-1e300] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        bpe, scores, at = self.bpe, self.scores, 0
        reached = [False] * (n + 1)
        reached[0] = True

        def fill(to: int) -> None:  # a character that no piece ends with is a piece of its own, unknown
            nonlocal at
            while at < to:
                at += 1
                if not reached[at] and (not bpe or s[at - 1] not in self.normal):
                    reached[at], piece[at], start[at] = True, -1, at - 1
                    score[at] = score[at - 1] - 1e6

        for end, (i, length) in self.automaton.iter(s):
            fill(end)
            e, b = end + 1, end + 1 - length
            if not reached[b]:
                continue
            if bpe:
                if not reached[e] and self._follows(piece[b] if b else -1, i):
                    reached[e], piece[e], start[e] = True, i, b
            elif score[b] + scores[i] > score[e]:
                reached[e], score[e], piece[e], start[e] = True, score[b] + scores[i], i, b
        fill(n)
        out: list[int] = []
        while n:
            i, b = piece[n], start[n]
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[c] for c in reversed(s[b:n].encode())]
            else:
                while b and piece[b] < 0:  # neighbouring unknown characters are one unknown
                    b = start[b]
                out.append(self.unknown)
            n = b
        return out[::-1]

    def _merged(self, s: str, n: int) -> list[int]:
        """The pass for a BPE model where every character is a piece: the last piece at each position, -2 for none."""
        last, start, pairs = [-2] * (n + 1), [0] * (n + 1), self.pairs
        last[0] = -1
        for end, (i, length) in self.automaton.iter(s):
            end += 1
            if last[end] == -2:
                begin = end - length
                left = last[begin]
                if left != -2:
                    ok = pairs.get((left, i))
                    if ok or (ok is None and self._follows(left, i)):
                        last[end] = i
                        start[end] = begin
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        out.reverse()
        return out

    def _follows(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' text from scratch gives these two pieces."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            want = [right] if left < 0 else [left, right]
            found = self.merge("".join(self.pieces[i] for i in want)) == want
            self.pairs[left, right] = found
        return found

    def merge(self, s: str) -> list[int]:
        """Plain byte-pair merging: the best-scored adjacent pair first, the leftmost of equals; -1 is unknown."""
        parts: list[str | None] = list(s)
        left, right = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.normal.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, b, parts[a] + parts[b]))

        for k in range(1, len(s)):
            offer(k - 1, k)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or parts[a] + parts[b] != joined or right[a] != b:
                continue
            parts[a], parts[b] = joined, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self.normal.get(p, -1) for p in parts if p is not None]

    def _run(self, n: int) -> list[int]:
        """Spaces that no word takes: their pieces have equal scores, so pairs don't decide them; they are merged."""
        if n not in self.runs:
            ids = [i if i >= 0 else self.unknown for i in self.merge(MARK * n)] if self.bpe else self._segment(MARK * n)
            if len(self.runs) > 4096:
                self.runs.clear()
            self.runs[n] = ids
        return self.runs[n]

    # -- decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        s = b"".join(map(self.table.__getitem__, ids.tolist()))
        return (s[1:] if self.prefix and s[:1] == b" " else s).decode(errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    """One model per worker process and file; the file may be local or in a store pyarrow reads."""
    fs, name = _store._filesystem(path) if "://" in path else _store._filesystem(f"file://{path}")
    with fs.open_input_stream(name) as f:
        return Model(f.read())


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of ints) of every whole text. Null and empty texts have no ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            ids = [np.frombuffer(m.encode(x or ""), m.dtype) for x in b.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(work), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids) and the decoded text of rows with ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            offsets, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            own = [flat[lo:hi] for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            crc = [zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in own]
            yield pa.record_batch([b.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array(crc, pa.int64()), pa.array([m.decode(x) for x in own], pa.string())], ["doc_id", "n_tokens", "ids_crc32", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(work), "doc_id long, n_tokens long, ids_crc32 long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_tokens, ids_crc32, decoded_sha256.

    One row for each row of ``docs``, other columns are left out. A null text is empty; a null ``doc_id``
    is passed on. The mark U+2581 in a text reads as a space, as in the format. No rows give no rows.
    Memory: a batch of texts, a bounded store of words and pairs.
    """
    out = decode_ids(encode_documents(docs, model), model)
    return out.select("doc_id", "n_tokens", "ids_crc32", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
