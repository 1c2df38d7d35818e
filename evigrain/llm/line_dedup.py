"""Line deduplication over an index of repeated lines.

Method: every line's key is hashed to 128 bits; Spark finds, by an aggregation that combines on the map
side, the keys that occur in two documents or more, with the smallest document and the number of
occurrences. Those keys are dealt to shards by hash. Each shard gets a minimal perfect hash (levels of
bit arrays with ranks) that indexes compact arrays: fingerprint, count, owner. Documents probe the
memory-mapped shards; lines are never joined.

Keys of one document only are left out of the index: the fingerprints answer for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._memory import lean
from ._text import mix

GAMMA = 2.0
MAX_LEVELS = 40
SHARD_KEYS = 1_000_000
NULL_ID = 2**63 - 1
_U = np.uint64


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: level by level, the keys alone in their slot keep it."""

    @staticmethod
    def build(keys: np.ndarray) -> dict[str, np.ndarray]:
        words, sizes, left = [], [], keys
        for level in range(MAX_LEVELS):
            if not len(left):
                break
            slots = max(64, -(-int(len(left) * GAMMA) // 64) * 64)
            at = PerfectHash._slot(left, level, slots)
            alone = np.bincount(at, minlength=slots) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(slots)
            left = left[~alone[at]]
        bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ranks = np.zeros(len(bits) + 1, np.uint32)
        np.cumsum(np.bitwise_count(bits), out=ranks[1:], dtype=np.uint32)
        return {"bits": bits, "ranks": ranks, "levels": np.array(sizes, np.int64), "rest": np.sort(left)}

    @staticmethod
    def _slot(keys: np.ndarray, level: int, slots: int) -> np.ndarray:
        return (mix(keys ^ mix(np.array([level + 1], np.uint64))) % _U(slots)).astype(np.int64)

    @staticmethod
    def find(arrays: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
        """Each key's index; -1 for some of the keys that aren't in the set, any index for the others."""
        bits, ranks, rest = arrays["bits"], arrays["ranks"], arrays["rest"]
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, slots in enumerate(arrays["levels"].tolist()):
            at = PerfectHash._slot(keys[open_], level, slots) + base
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word[hit] & ((_U(1) << bit[hit]) - _U(1)))
            out[open_[hit]] = ranks[at[hit] >> 6] + below
            open_, base = open_[~hit], base + slots
        if len(rest) and len(open_):
            at = np.minimum(np.searchsorted(rest, keys[open_]), len(rest) - 1)
            hit = rest[at] == keys[open_]
            out[open_[hit]] = int(ranks[-1]) + at[hit]
        return out


def _keys(text: bytes, least: int) -> tuple[list[bytes], list[int], list[tuple[int, int]]]:
    """The lines of a text; the numbers of those with a key long enough, and the keys' hashes."""
    lines, places, found = text.split(b"\n"), [], []
    for i, line in enumerate(lines):
        key = line.strip().lower()  # of bytes: only ASCII white space and A-Z
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
            h = xxhash.xxh3_128_intdigest(key)
            places.append(i)
            found.append((h >> 64, h & (2**64 - 1)))
    return lines, places, found


def _signed(values: list[int] | np.ndarray) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _repeated(docs: DataFrame, least: int) -> DataFrame:
    """Keys in two documents or more: key hash (h1, h2), smallest document, rows that hold the key."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, owner = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                own = set(_keys(text, least)[2])
                h1 += [x for x, _ in own]
                h2 += [x for _, x in own]
                owner += [doc] * len(own)
            yield pa.record_batch([pa.array(_signed(h1)), pa.array(_signed(h2)), pa.array(owner, pa.int64())], ["h1", "h2", "doc"])

    return (
        docs.mapInArrow(lean(lines), "h1 long, h2 long, doc long")
        .groupBy("h1", "h2")
        .agg(F.min("doc").alias("owner"), F.max("doc").alias("other"), F.count("*").alias("n"))
        .where("owner < other")
        .select("h1", "h2", "owner", "n")
    )


def build_index(docs: DataFrame, store: _store.Store, least: int) -> list[str]:
    """Writes the shards of the index; returns the shards' files (one per ``SHARD_KEYS`` repeated keys)."""
    keys = store.table(_repeated(docs, least), "repeated-lines")
    shards, folder = _store.cut(keys.count(), SHARD_KEYS), store.uri

    def build(key: tuple, table: pa.Table) -> pa.Table:
        h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        key64 = mix(h1) ^ h2
        arrays = PerfectHash.build(key64)
        at = PerfectHash.find(arrays, key64)
        for name, values in (("print", h2), ("count", np.minimum(table["n"].to_numpy(), 2**32 - 1).astype(np.uint32)), ("owner", table["owner"].to_numpy())):
            arrays[name] = np.empty_like(values)
            arrays[name][at] = values
        return pa.table({"shard": [key[0].as_py()], "path": [_store.write_arrays(f"{folder}/line-index", f"s{key[0].as_py()}", arrays)]})

    made = keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("long")).groupBy("shard").applyInArrow(build, "shard long, path string")
    paths = dict(store.table(made, "line-index-files").collect())
    return [paths.get(i, "") for i in range(shards)]


def _owners(files: list[str], found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are repeated, and the owning document of each of these (``NULL_ID`` for a null)."""
    out, repeated = np.zeros(len(found), np.int64), np.zeros(len(found), bool)
    if not found:
        return repeated, out
    both = np.array(found, np.uint64)
    shard = np.mod(both[:, 0].view(np.int64) if both[:, 0].flags.c_contiguous else np.ascontiguousarray(both[:, 0]).view(np.int64), len(files))
    key64 = mix(both[:, 0]) ^ both[:, 1]
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(len(files) + 1))
    for s in np.unique(shard).tolist():
        rows = order[cuts[s] : cuts[s + 1]]
        if files[s]:
            arrays = _store.open_arrays(files[s])
            at = PerfectHash.find(arrays, key64[rows])
            inside = at >= 0
            hit = arrays["print"][at[inside]] == both[rows[inside], 1]
            out[rows[inside][hit]] = arrays["owner"][at[inside][hit]]
            repeated[rows[inside][hit]] = arrays["count"][at[inside][hit]] > 1
    return repeated, out


def dedup_lines(docs: DataFrame, least: int = 10, keep: list[str] | None = None) -> DataFrame:
    """Drops repeated lines; returns doc_id, kept_text, n_lines, n_dropped and the columns named in ``keep``.

    ``docs`` needs ``doc_id`` (whole numbers below 2 ** 63 - 1, or null) and ``text``; other columns are left out.
    A text is split at ``\\n``. A line's key is the line without ASCII white space at its ends, A-Z in lower
    case. Keys of at least ``least`` code points found in two documents or more lose their lines everywhere
    but in the smallest document. Rows with the same ``doc_id`` are the same document. Null or empty texts
    are one empty line. A null ``doc_id`` sorts after every other, and such rows count as one document.
    No rows give no rows. Memory: one batch of texts and the touched pages of the mapped index.
    """
    names = [c for c in keep or [] if c not in ("doc_id", "kept_text", "n_lines", "n_dropped")]
    kinds = "".join(f", `{c}` {t}" for c, t in docs.select(*names).dtypes) if names else ""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_own{i}") for i, c in enumerate(names)])
    store = _store.Store(docs.sparkSession, "line-dedup")
    files = build_index(docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text"), store, least)
    store.keep_only("line-index")

    def drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, found, owner = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                lines, places, own = _keys(text, least)
                parts.append((lines, places))
                found += own
                owner += [NULL_ID if doc is None else doc] * len(own)
            repeated, first = _owners(files, found)
            drop = repeated & (first != np.array(owner, np.int64))
            at, kept, before, gone = 0, [], [], []
            for lines, places in parts:
                own = drop[at : at + len(places)]
                at += len(places)
                out = {places[i] for i in np.flatnonzero(own).tolist()}
                kept.append(b"\n".join([x for i, x in enumerate(lines) if i not in out]) if out else b"\n".join(lines))
                before.append(len(lines))
                gone.append(len(out))
            yield pa.record_batch([b.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64()), *b.columns[2:]], ["doc_id", "kept_text", "n_lines", "n_dropped", *names])

    return docs.mapInArrow(lean(drop_lines), f"doc_id long, kept_text string, n_lines long, n_dropped long{kinds}")
