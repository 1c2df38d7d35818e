"""Bigram language model with interpolated modified Kneser-Ney smoothing.

Spark counts: a map stage tokenises whole texts with numpy and sends, for each shard, the counts of a few
million tokens at a time as one compact blob; a reduce stage merges the blobs of a shard. Words and bigrams
are 64-bit hashes, kept as sorted arrays in files of the shared folder:

* word shards (by hash): word, count, distinct left neighbours, words seen after it once, twice, more;
* bigram shards: bigram key, count.

A bigram's shard is its left word's, except for words so frequent that one shard would hold too many of
their bigrams; those are dealt by both words. Scoring workers memory-map the shards and look up the distinct
words and bigrams of a batch in order, so reads run through each array once. Discounts come from the counts
of counts, which are sums over shards. No table of n-grams is ever collected or broadcast.

Higher orders would need more disk than the budget of four times the input: trigrams alone outnumber
bigrams by half on texts like these (see the README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._memory import lean
from ._text import chunks, combine, distinct_inverse, runs, word_hashes

END = np.uint64(0xE0D0F7E27000001)
BEGIN = np.uint64(0xBE61777E27000002)
FLUSH_TOKENS = 1 << 21
SHARD_BIGRAMS = 1 << 20
_U = np.uint64


def _stream(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, the words of these rows with an end after each row, and where each row ends."""
    for first, last, data, offsets in chunks(column):
        words, at = word_hashes(data, offsets)
        rows = last - first
        out = np.empty(len(words) + rows, np.uint64)
        ends = at[1:] + np.arange(rows)
        out[ends] = END
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = words
        yield first, last, out, ends


def _left(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The left neighbour of each word; the begin mark at the start of a row."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[0] = BEGIN
    starts = ends[:-1] + 1
    out[starts] = BEGIN
    return out


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _bigram(u: np.ndarray, w: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """A bigram's key: its shard in the top bits, a hash of both words below."""
    both = combine(u, w)
    if not bits:
        return both
    top = u.copy()
    if len(hot):
        at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
        often = hot[at] == u
        top[often] = both[often] * _U(0x9E3779B97F4A7C15)
    return (top >> _U(64 - bits) << _U(64 - bits)) | (both >> _U(bits))


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays), *(a.dtype.itemsize for a in arrays)], np.int64)
    return head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(blob: bytes | memoryview) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for length, width in zip(head[:n].tolist(), head[n:].tolist(), strict=True):
        out.append(np.frombuffer(blob, f"<u{width}", length, at))
        at += length * width
    return out


def _narrow(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max(initial=0))
    return counts.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _blobs(shards: list[int], blobs: list[bytes], places: list[int]) -> pa.RecordBatch:
    """Blobs under the places of their shards."""
    return pa.record_batch([pa.array([places[s] for s in shards], pa.int64()), pa.array(blobs, pa.large_binary())], ["shard", "blob"]).cast(pa.schema([("shard", pa.int64()), ("blob", pa.binary())]))


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Shard, start and end of each run of a sorted shard column."""
    at = runs(shard)
    yield from zip(shard[at].tolist(), at.tolist(), [*at[1:].tolist(), len(shard)], strict=True)


def _word_counts(texts: DataFrame, bits: int, places: list[int]) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            s = np.sort(np.concatenate(held))
            at = runs(s)
            words, counts = s[at], np.diff(np.append(at, len(s)))
            out = [(k, _pack(words[a:b], _narrow(counts[a:b]))) for k, a, b in _by_shard(_shard(words, bits))]
            return _blobs([k for k, _ in out], [x for _, x in out], places)

        for b in batches:
            for first, last, words, _ in _stream(b.column(0)):
                held += [words, np.full(last - first, BEGIN)]
                size += len(words)
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(lean(count), "shard long, blob binary")


def _merged(keys: list[np.ndarray], values: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums each list of values over equal keys."""
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k = k[order]
    at = runs(k)
    return k[at], [np.add.reduceat(np.concatenate(v).astype(np.int64)[order], at) if len(k) else np.zeros(0, np.int64) for v in values]


def _column_blobs(table: pa.Table, name: str = "blob") -> list[list[np.ndarray]]:
    return [_unpack(x.as_buffer()) for chunk in table[name].chunks for x in chunk]


class Model:
    """Where the shards are, and the discounts."""

    def __init__(self, word_bits: int, words: list[str], bits: int, bigrams: list[str], neighbours: list[str], hot: np.ndarray, tokens: int, vocabulary: int, count_of_counts: list[int], count_of_left: list[int]):
        self.word_bits, self.words, self.bits, self.bigrams, self.neighbours = word_bits, words, bits, bigrams, neighbours
        self.hot, self.tokens, self.vocabulary = hot, tokens, vocabulary
        self.discount, self.left_discount = _discounts(count_of_counts), _discounts(count_of_left)
        self.left_once, self.left_twice, _, _, self.left_often, self.left_total = count_of_left

    def _find(self, files: list[str], bits: int, keys: np.ndarray, field: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray, dict]]:
        """For sorted keys, shard by shard: their range, places in the shard, whether they are there, its arrays."""
        for s, a, b in _by_shard(_shard(keys, bits)):
            if files[s]:
                arrays = _store.open_arrays(files[s])
                table = arrays[field]
                if len(table):
                    at = np.searchsorted(table, keys[a:b])
                    at[at == len(table)] = 0
                    yield slice(a, b), at, table[at] == keys[a:b], arrays

    def word_stats(self, words: np.ndarray) -> np.ndarray:
        """Of sorted distinct words: count, left neighbours, words seen after it once, twice, more often."""
        out = np.zeros((5, len(words)), np.int64)
        for span, at, hit, arrays in self._find(self.words, self.word_bits, words, "word"):
            out[0, span] = np.where(hit, arrays["count"][at], 0)
            s = int(_shard(words[span.start : span.start + 1], self.word_bits)[0])
            more = _store.open_arrays(self.neighbours[s])
            for i, name in enumerate(("left", "once", "twice", "often"), 1):
                out[i, span] = np.where(hit, more[name][at], 0)
        return out

    def bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys."""
        out = np.zeros(len(keys), np.int64)
        for span, at, hit, arrays in self._find(self.bigrams, self.bits, keys, "key"):
            n = arrays["count"][at].astype(np.int64)
            big = hit & (n == 255)
            if big.any():
                n[big] = arrays["big_count"][np.searchsorted(arrays["big_key"], keys[span][big])]
            out[span] = np.where(hit, n, 0)
        return out

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))

    def lower(self, left: np.ndarray) -> np.ndarray:
        """The lower order: from the number of left neighbours, interpolated with 1 / (V + 1)."""
        total = max(self.left_total, 1)
        d = self.left_discount
        spare = (d[1] * self.left_once + d[2] * self.left_twice + d[3] * self.left_often) / total if self.left_total else 1.0
        return np.maximum(left - d[np.minimum(left, 3)], 0) / total + spare / (self.vocabulary + 1)

    def score(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: its training count, base log10 probability, the model's log10 probability."""
        known, place = distinct_inverse(words)
        stats = self.word_stats(known)
        u = _left(words, ends)
        before = np.empty_like(place)
        before[1:] = place[:-1]
        before[0] = 0
        first = np.concatenate([[0], ends[:-1] + 1])
        begin = self.word_stats(np.array([BEGIN]))[:, 0]
        context = stats[:, before]
        context[:, first] = begin[:, None]
        keys = _bigram(u, words, self.hot, self.bits)
        order = np.argsort(keys)
        counts = np.empty(len(keys), np.int64)
        counts[order] = self.bigram_counts(keys[order])
        d = self.discount
        seen = context[0] > 0
        total = np.maximum(context[0], 1)
        spare = np.where(seen, (d[1] * context[2] + d[2] * context[3] + d[3] * context[4]) / total, 1.0)
        p = np.maximum(counts - d[np.minimum(counts, 3)], 0) / total + spare * self.lower(stats[1])[place]
        count = stats[0][place]
        return count, self.base(count), np.log10(p)


def _discounts(n: list[int]) -> np.ndarray:
    """The three discounts of modified Kneser-Ney from the counts of counts 1 to 4, with plain ones where
    a count of counts is nought."""
    n1, n2, n3, n4 = n[:4]
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return np.array([0.0, *(min(max(x, 0.01), k - 0.01) for k, x in enumerate(d, 1))])


def _count_of(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4, how many are 3 or more, and their sum: [n1, n2, n3, n4, 3 or more, sum]."""
    b = np.bincount(np.minimum(counts, 5), minlength=6)
    return [int(x) for x in (*b[1:5], b[3:].sum(), counts.sum())]


def _places(spark, bits: int) -> list[int]:
    """For each of 2 ** ``bits`` partitions a number that Spark's hash deals to it: shards named by these never meet in one."""
    n = 1 << bits
    found = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id")).collect()
    out = dict(zip([r.part for r in found], [r.id for r in found], strict=True))
    return [out.get(i, 64 * n + i) for i in range(n)]


def _dealt(blobs: DataFrame, bits: int):
    """A partition for each shard, so that what a task reads doesn't grow with the corpus."""
    return blobs.repartition(1 << bits, "shard").groupBy("shard")


def fit(texts: DataFrame) -> Model:
    """Counts the training texts (one string column) and writes the model's shards."""
    store = _store.Store(texts.sparkSession, "kneser-ney")
    folder = f"{store.uri}/arrays"
    word_bits = (_store.cut(_store.input_bytes(texts), 4 << 20, 4) - 1).bit_length()

    word_places = _places(store.spark, word_bits)
    word_shard = {place: s for s, place in enumerate(word_places)}

    def merge_words(key: tuple, table: pa.Table) -> pa.Table:
        shard = word_shard[key[0].as_py()]
        parts = _column_blobs(table)
        words, (counts,) = _merged([p[0] for p in parts], [[p[1] for p in parts]])
        path = _store.write_arrays(folder, f"words{shard}", {"word": words, "count": counts.astype(np.uint64 if counts.max(initial=0) >> 32 else np.uint32)})
        real = words != BEGIN
        return pa.table({"shard": [shard], "path": [path], "tokens": [int(counts[real].sum())], "vocabulary": [int(real.sum())]})

    made = _dealt(_word_counts(texts, word_bits, word_places), word_bits).applyInArrow(merge_words, "shard long, path string, tokens long, vocabulary long")
    made = store.table(made, "words").collect()  # a row for each shard
    words = [""] * (1 << word_bits)
    for r in made:
        words[r.shard] = r.path
    tokens, vocabulary = sum(r.tokens for r in made), sum(r.vocabulary for r in made)
    bits = max(_store.cut(tokens // 2, SHARD_BIGRAMS, 4) - 1, 1).bit_length()
    limit = max(tokens >> (bits + 2), 1000)  # fewer than 4 << bits words are as frequent

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                a = _store.open_arrays(path)
                yield pa.record_batch([pa.array(a["word"][a["count"] > limit].view(np.int64))], ["word"])

    paths = store.spark.createDataFrame([(p,) for p in words if p] or [], "path string")
    hot = np.sort(np.array([r.word for r in paths.mapInArrow(lean(frequent), "word long").collect()], np.int64).view(np.uint64))

    places = _places(store.spark, bits)
    shard_of = {place: s for s, place in enumerate(places)}

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            u, w = np.concatenate(left), np.concatenate(right)
            keys = _bigram(u, w, hot, bits)
            order = np.argsort(keys)
            keys = keys[order]
            at = runs(keys)
            counts, first = np.diff(np.append(at, len(keys))), order[at]
            shard, u, w = _shard(keys[at], bits), u[first], w[first]
            del keys, order
            shards, blobs = [], []
            for s, a, b in _by_shard(shard):
                by_left = np.argsort(u[a:b], kind="stable")
                us = u[a:b][by_left]
                start = runs(us)
                shards.append(s)
                blobs.append(_pack(us[start], _narrow(np.diff(np.append(start, b - a))), w[a:b][by_left], _narrow(counts[a:b][by_left])))
            yield _blobs(shards, blobs, places)

        for b in batches:
            for _, _, words, ends in _stream(b.column(0)):
                left.append(_left(words, ends))
                right.append(words)
                size += len(words)
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    left, right, size = [], [], 0
        if size:
            yield from flush()

    def merge_bigrams(key: tuple, table: pa.Table) -> pa.Table:
        shard = shard_of[key[0].as_py()]
        parts = _column_blobs(table)
        u = np.concatenate([np.repeat(p[0], p[1].astype(np.int64)) for p in parts])
        w = np.concatenate([p[2] for p in parts])
        c = np.concatenate([p[3].astype(np.int64) for p in parts])
        del parts
        keys = _bigram(u, w, hot, bits)
        order = np.argsort(keys)
        keys = keys[order]
        at = runs(keys)
        counts = np.add.reduceat(c[order], at)
        first = order[at]
        keys, u, w = keys[at], u[first], w[first]
        del order, c
        big = counts >= 255
        path = _store.write_arrays(folder, f"bigrams{shard}", {"key": keys, "count": np.minimum(counts, 255).astype(np.uint8), "big_key": keys[big], "big_count": counts[big]})
        own = pa.record_batch([pa.array([shard]), pa.array([path]), pa.array([_count_of(counts)], pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.array([0])], names)
        ws = np.sort(w)
        start = runs(ws)
        left = (ws[start], _narrow(np.diff(np.append(start, len(ws)))))
        by_left = np.argsort(u, kind="stable")
        us, kind = u[by_left], np.minimum(counts[by_left], 3)
        start = runs(us)
        right = (us[start], *(_narrow(np.add.reduceat((kind == k).astype(np.int64), start)) for k in (1, 2, 3)))
        shards, blobs, what = [], [], []
        for i, (k, *values) in enumerate((left, right), 1):
            for s, a, b in _by_shard(_shard(k, word_bits)):
                shards.append(word_places[s])
                blobs.append(_pack(k[a:b], *(v[a:b] for v in values)))
                what.append(i)
        sent = pa.record_batch([pa.array(shards, pa.int64()), pa.nulls(len(shards), pa.string()), pa.nulls(len(shards), pa.list_(pa.int64())), pa.array(blobs, pa.binary()), pa.array(what, pa.int64())], names)
        return pa.Table.from_batches([own, sent])

    names = ["shard", "path", "counts", "blob", "what"]
    counted = _dealt(texts.mapInArrow(lean(count_bigrams), "shard long, blob binary"), bits)
    counted = store.table(counted.applyInArrow(merge_bigrams, "shard long, path string, counts array<long>, blob binary, what long"), "bigrams")
    bigrams, of_counts = [""] * (1 << bits), np.zeros(6, np.int64)
    for r in counted.where("what = 0").select("shard", "path", "counts").collect():
        bigrams[r.shard] = r.path
        of_counts += r.counts

    def merge_neighbours(key: tuple, table: pa.Table) -> pa.Table:
        s = word_shard[key[0].as_py()]
        known = _store.open_arrays(words[s])["word"]
        out = {k: np.zeros(len(known), np.int64) for k in ("left", "once", "twice", "often")}
        what = table["what"].to_pylist()
        for kind, blob in zip(what, _column_blobs(table), strict=True):
            at = np.searchsorted(known, blob[0])
            for name, v in zip(("left",) if kind == 1 else ("once", "twice", "often"), blob[1:], strict=True):
                out[name][at] += v.astype(np.int64)
        path = _store.write_arrays(folder, f"neighbours{s}", {k: _narrow(v) for k, v in out.items()})
        return pa.table({"shard": [s], "path": [path], "counts": pa.array([_count_of(out["left"])], pa.list_(pa.int64()))})

    merged = _dealt(counted.where("what > 0").select("shard", "what", "blob"), word_bits).applyInArrow(merge_neighbours, "shard long, path string, counts array<long>")
    neighbours, of_left = [""] * (1 << word_bits), np.zeros(6, np.int64)
    for r in store.table(merged, "neighbours").collect():
        neighbours[r.shard] = r.path
        of_left += r.counts
    store.keep_only("arrays")
    return Model(word_bits, words, bits, bigrams, neighbours, hot, tokens, vocabulary, of_counts.tolist(), of_left.tolist())


def score_documents(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Scores whole texts with a model of the documents whose crc32(doc_id) mod ``folds`` is not 0.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row for each row of
    ``docs``; other columns are left out. A token is a word or the end of a text; a null or empty text is
    an end alone. A null ``doc_id`` is in no fold: its row isn't learned from, ``held_out`` is null. A row
    that comes twice is learned twice. No rows give no rows; without training rows all words are unknown.
    Memory: some millions of tokens on a worker; the model is mapped, not loaded.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    model = fit(docs.where(fold != 0).select("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [np.zeros(len(b), t) for t in (np.int64, np.int64, float, float)]
            for first, last, words, ends in _stream(b.column(1)):
                count, base, kn = model.score(words, ends)
                start = np.concatenate([[0], ends[:-1] + 1])
                for c, v in zip(cols, (np.ones(len(words), np.int64), (count > 0).astype(np.int64), base, kn), strict=True):
                    c[first:last] = np.add.reduceat(v, start)
            yield pa.record_batch([b.column(0), *(pa.array(c) for c in cols)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = docs.mapInArrow(lean(score), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
