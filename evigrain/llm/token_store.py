"""Token ids in binary shards with Elias-Fano encoded document boundaries.

A shard holds the ids of its documents in a row, the boundaries as an Elias-Fano sequence (low bits
packed, high bits in unary with sampled select) and the documents' numbers, Elias-Fano encoded as well.
Shards follow one another in ascending ``doc_id`` order. There is no table of 64-bit offsets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bpe, _store
from ._memory import lean

SAMPLE = 256
SHARD_BYTES = 16 << 20


class EliasFano:
    """A non-decreasing sequence of whole numbers in near-minimal space, with random access."""

    @staticmethod
    def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if low else np.zeros(0, np.uint8)
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return {f"{name}.meta": np.array([n, low], np.int64), f"{name}.low": np.packbits(bits, bitorder="little"), f"{name}.high": np.packbits(high, bitorder="little"), f"{name}.select": ones[::SAMPLE].astype(np.uint64)}

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.low_bits = arrays[f"{name}.meta"].tolist()
        self.low, self.high, self.samples = (arrays[f"{name}.{k}"] for k in ("low", "high", "select"))

    def _low(self, lo: int, hi: int) -> np.ndarray:
        w = self.low_bits
        if not w:
            return np.zeros(hi - lo, np.int64)
        a, b = lo * w, hi * w
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(-1, w).astype(np.int64) @ (1 << np.arange(w, dtype=np.int64))

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Values ``lo`` to ``hi`` - 1: select finds the sample before ``lo``, the rest is read from there."""
        if hi <= lo:
            return np.zeros(0, np.int64)
        first = lo // SAMPLE
        begin = int(self.samples[first])
        last = (hi - 1) // SAMPLE + 1
        end = int(self.samples[last]) + 1 if last < len(self.samples) else len(self.high) * 8
        ones = begin - begin % 8 + np.flatnonzero(np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little"))
        ones = ones[ones >= begin][lo - first * SAMPLE : hi - first * SAMPLE]
        return ((ones - np.arange(lo, hi)) << self.low_bits) | self._low(lo, hi)

    def select(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes whole texts, appends ``end_id`` to each and writes shards in ascending ``doc_id`` order.

    Returns one row a shard: place, path, documents and ids in it. A null text is empty, a null ``doc_id``
    comes before all others, rows with the same ``doc_id`` follow one another by a hash of the text, then by
    text, over as many shards as they fill. No rows, no shards.
    Memory: a shard's ids (about ``shard_bytes`` of text) and one batch of texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    parts = _store.cut(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, shard_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _bpe.tokenizer(vocabulary)
        end = np.array([end_id], t.dtype)
        ids, sizes, numbers, ties = [], [], [], []
        for b in batches:
            numbers += b.column(0).to_pylist()
            ties += b.column(2).to_pylist()
            for x in t.encode(b.column(1)):
                ids += [x, end]
                sizes.append(len(x) + 1)
        if not sizes:
            return
        bounds = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        known = np.array([x is not None for x in numbers], np.uint8)
        order = np.array([-(2**63) if x is None else x for x in numbers], np.int64)
        base = int(order[known == 1][0]) if known.any() else 0
        arrays = {"ids": np.concatenate(ids), "known": np.packbits(known, bitorder="little"), "base": np.array([base], np.int64)}
        arrays |= EliasFano.encode(bounds, "bounds") | EliasFano.encode(np.where(known == 1, order - base, 0), "doc")
        path = _store.write_arrays(folder, "shard", arrays)
        yield pa.record_batch([pa.array([int(order[0])]), pa.array([int(order[-1])]), pa.array([ties[0]]), pa.array([bool(known[0])]), pa.array([len(sizes)]), pa.array([int(bounds[-1])]), pa.array([path])], ["first_doc", "last_doc", "first_tie", "known", "n_docs", "n_ids", "path"])

    dealt = docs.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return dealt.mapInArrow(lean(write), "first_doc long, last_doc long, first_tie long, known boolean, n_docs long, n_ids long, path string")


class Shard:
    """A reader of one shard."""

    def __init__(self, path: str):
        a = _store.open_arrays(path)
        self.ids, self.bounds, self.docs = a["ids"], EliasFano(a, "bounds"), EliasFano(a, "doc")
        self.known, self.base = a["known"], int(a["base"][0])

    def __len__(self) -> int:
        return self.bounds.n - 1

    def document(self, i: int) -> np.ndarray:
        lo, hi = self.bounds.slice(i, i + 2).tolist()
        return self.ids[lo:hi]

    def numbers(self) -> list[int | None]:
        known = np.unpackbits(self.known, bitorder="little", count=len(self))
        return [int(x) + self.base if k else None for x, k in zip(self.docs.slice(0, len(self)), known, strict=True)]


def read_tokens(spark, shards: list[tuple[str, int]]) -> DataFrame:
    """Reads shards (path, ids in all shards before it): per document its number, start, length and CRC-32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = Shard(path)
                bounds, numbers = s.bounds.slice(0, len(s) + 1), s.numbers()
                for lo in range(0, len(s), 4096):
                    hi = min(len(s), lo + 4096)
                    crc = [zlib.crc32(s.ids[bounds[i] : bounds[i + 1]].astype("<u4")) for i in range(lo, hi)]
                    yield pa.record_batch([pa.array(numbers[lo:hi], pa.int64()), pa.array(bounds[lo:hi] + base), pa.array(np.diff(bounds[lo : hi + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame(shards, "path string, base long").repartition(max(1, len(shards)))
    return rows.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, vocabulary: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the ids of ``docs`` to the shared folder and reads them back (see :func:`read_tokens`).

    The driver holds one small row per shard, to number the ids across shards.
    """
    spark = docs.sparkSession
    store = _store.Store(spark, "token-store")
    made = store.table(write_tokens(docs, vocabulary, f"{store.uri}/tokens", end_id, shard_bytes), "shards").collect()
    store.keep_only("tokens")
    base, shards = 0, []
    for r in sorted(made, key=lambda r: (r.known, r.first_doc, r.first_tie, r.last_doc)):
        shards.append((r.path, base))
        base += r.n_ids
    return read_tokens(spark, shards)
