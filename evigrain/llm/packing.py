"""Packing documents into sequences of a fixed length.

Method: the histogram of piece lengths (at most ``size`` numbers, whatever the corpus) goes to the driver.
Length bins are combined into patterns of a few pieces that fill a sequence; non-negative least squares
fits how often to repeat each pattern, the counts are rounded down and filled with exact lengths, and the
pieces left over go, longest first, into the smallest gap that holds them. The plan that comes out is a
table of runs: pieces of one length, ranked, take consecutive sequences at one offset. Spark ranks the
pieces within a length (salted, so that a common length is no single task) and looks their run up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bpe, _store
from ._memory import lean

BINS = 64
PATTERN_PIECES = 3
SALT_ROWS = 200_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gram, target = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, np.abs(target).max(initial=0.0))
    for _ in range(rounds):
        gain = np.where(used, -np.inf, target - gram @ x)
        best = int(gain.argmax())
        if gain[best] <= tol:
            break
        used[best] = True
        while True:
            on = np.flatnonzero(used)
            s = np.linalg.lstsq(gram[np.ix_(on, on)], target[on], rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[on] = s
                break
            bad = s <= 0
            step = np.min(x[on][bad] / np.maximum(x[on][bad] - s[bad], 1e-300))
            x[on] += step * (s - x[on])
            used[on[(x[on] <= 1e-12) & bad]] = False
            x[~used] = 0
    return x


def patterns(bins: int, present: set[int], pieces: int) -> list[tuple[int, ...]]:
    """Multisets of 2 to ``pieces`` present bins that together fill all ``bins``."""
    found = []
    for n in range(2, pieces + 1):
        for head in combinations_with_replacement(sorted(present), n - 1):
            last = bins - sum(head)
            if last >= head[-1] and last in present:
                found.append((*head, last))
    return found


class Plan:
    """Where pieces go: runs of (length, first rank, count, first sequence, offset)."""

    def __init__(self, size: int, histogram: dict[int, int], bins: int = BINS, pieces: int = PATTERN_PIECES):
        self.size, self.runs, self.sequences = size, [], 0
        self.left = {k: int(v) for k, v in histogram.items() if v}
        self.taken: dict[int, int] = defaultdict(int)
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room: runs of (sequence, count)
        if n := self.left.get(size):
            self._open([size], n)
        self._patterns(bins, pieces)
        self._best_fit()

    def _place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.taken[length], count, sequence, offset))
        self.taken[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _open(self, lengths: list[int], count: int) -> None:
        """``count`` new sequences that each begin with these lengths."""
        offset = 0
        for length in lengths:
            self._place(length, count, self.sequences, offset)
            offset += length
        if offset < self.size:
            self.gaps[self.size - offset].append((self.sequences, count))
        self.sequences += count

    def _patterns(self, bins: int, pieces: int) -> None:
        step = -(-self.size // bins)
        counts: dict[int, int] = defaultdict(int)
        for length, n in self.left.items():
            counts[-(-length // step)] += n
        order = sorted(counts)
        found = patterns(-(-self.size // step), set(order), pieces)
        if not found:
            return
        a, row = np.zeros((len(order), len(found))), {b: i for i, b in enumerate(order)}
        for j, p in enumerate(found):
            for b in p:
                a[row[b], j] += 1
        h = np.array([counts[b] for b in order], float)
        weight = np.array([b for b in order], float)[:, None]  # room, not pieces, is what a miss costs
        repeats = np.floor(nnls(a * weight, h * weight[:, 0]) + 1e-6).astype(int)
        for j in sorted(np.flatnonzero(repeats), key=lambda j: -max(found[j])):
            self._fill([b for b in reversed(found[j])], int(repeats[j]), step)

    def _fill(self, pattern: list[int], repeats: int, step: int) -> None:
        """Takes exact lengths for ``repeats`` copies, a run at a time: the longest of each bin, and at last
        the length that best fits what is left of the sequence (in its bin or the one above)."""
        while repeats:
            need: dict[int, int] = {}
            lengths: list[int] = []
            for i, b in enumerate(pattern):
                top = b * step if i < len(pattern) - 1 else self.size - sum(lengths)
                x = next((y for y in range(top, (b - 1) * step, -1) if self.left.get(y, 0) > need.get(y, 0)), 0)
                if not x:
                    return
                need[x] = need.get(x, 0) + 1
                lengths.append(x)
            n = min([repeats, *(self.left[x] // k for x, k in need.items())])
            self._open(lengths, n)
            repeats -= n

    def _best_fit(self) -> None:
        rooms = sorted(self.gaps)
        for length in sorted(self.left, reverse=True):
            while (n := self.left.get(length, 0)) > 0:
                i = bisect_left(rooms, length)
                if i == len(rooms):
                    each = self.size // length
                    if n >= each:
                        before = self.size - each * length
                        self._open([length] * each, n // each)
                        if before and len(self.gaps[before]) == 1:
                            insort(rooms, before)
                        continue
                    self._open([length] * n, 1)
                    room = self.size - n * length
                    if room and len(self.gaps[room]) == 1:
                        insort(rooms, room)
                    continue
                room = rooms[i]
                sequence, count = self.gaps[room].pop()
                take = min(n, count)
                if take < count:
                    self.gaps[room].append((sequence + take, count - take))
                self._place(length, take, sequence, self.size - room)
                if not self.gaps[room]:
                    del self.gaps[room]
                    rooms.pop(i)
                if rest := room - length:
                    self.gaps[rest].append((sequence, take))
                    if len(self.gaps[rest]) == 1:
                        insort(rooms, rest)


def token_pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int = 0) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _bpe.tokenizer(vocabulary)
        for b in batches:
            out = []
            for doc, x in zip(b.column(0).to_pylist(), t.encode(b.column(1)), strict=True):
                ids = np.append(x, end_id).astype("<u4")
                out += [(doc, k, at, min(size, len(ids) - at), zlib.crc32(ids[at : at + size])) for k, at in enumerate(range(0, len(ids), size))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, bins: int = BINS) -> DataFrame:
    """Packs whole texts into as few sequences of at most ``size`` tokens as the method finds.

    A document is its text's ids and ``end_id``; only longer ones are cut, into pieces of ``size``, the
    last perhaps shorter. Returns one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. A null or empty text is ``end_id`` alone. Null and repeated ``doc_id`` are packed like others;
    other columns are left out; no rows give no rows. Memory: the histogram and the plan on the driver,
    both bounded by ``size`` and ``bins``; a batch of texts on a worker.
    """
    store = _store.Store(docs.sparkSession, "packing")
    pieces = store.table(token_pieces(docs, vocabulary, size, end_id), "pieces")
    return place(pieces, size, bins)


def place(pieces: DataFrame, size: int, bins: int = BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with doc_id, piece and length."""
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(size, histogram, bins)
    table = {k: np.array(sorted((first, n, seq, off) for _, first, n, seq, off in v), np.int64).T for k, v in _grouped(plan.runs).items()}
    # a length's salts follow its own count; their table has a row for each length (at most ``size``)
    salts = pieces.sparkSession.createDataFrame([(k, _store.cut(n, SALT_ROWS, min(n, 16))) for k, n in histogram.items()], "length long, _salts int")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), "_salts").cast("int")).drop("_salts")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", *[c for c in ("ids_crc32",) if c in pieces.columns])
    # 16 rows at most for each length, and one for every SALT_ROWS pieces
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = salted.withColumn("_in", F.row_number().over(within)).join(sizes, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_in") - 1).select(*pieces.columns, "_rank")
    columns = pieces.columns

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            seq, off = np.empty_like(rank), np.empty_like(rank)
            for x in np.unique(length).tolist():
                rows = np.flatnonzero(length == x)
                first, _, base, offset = table[x]
                at = np.searchsorted(first, rank[rows], "right") - 1
                seq[rows] = base[at] + rank[rows] - first[at]
                off[rows] = offset[at]
            yield pa.record_batch([*(b.column(c) for c in columns), pa.array(seq), pa.array(off)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(lean(look_up), f"{kinds}, sequence_id long, offset long")


def _grouped(runs: list[tuple[int, int, int, int, int]]) -> dict[int, list]:
    out = defaultdict(list)
    for r in runs:
        out[r[0]].append(r)
    return out
