"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse random index vector, made from its hash. Over a bounded sample of labelled
documents, read whole, each word's context vector sums the index vectors of its neighbours (random
indexing). Words live in a fixed number of hash buckets, so the vectors are one small matrix; tasks sum
parts of it, and the driver gets the merged sums and each sampled row's features. Each text yields, beside its
words, pseudo-words for form: the shape of a word, a repetition of the word before, the length class of a
line. Pooled context vectors and pooled index vectors make a document's features. A two-layer numpy
network is trained on them, and its logits are divided by a temperature fitted on rows kept apart from
its training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._memory import lean
from ._text import chunks, mix, runs, spans, word_hashes

BUCKETS = 1 << 14
DIM = 64
NONZERO = 6
WINDOW = 2
SAMPLE = 6_000
SLICE = 64
CHUNK = 1 << 18
HIDDEN = 32
_U = np.uint64
_CLASS = np.full(256, 4, np.uint8)  # other signs
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 3
_CLASS[128:] = 0  # parts of letters beyond ASCII, mostly


def index_vectors(buckets: int = BUCKETS, dim: int = DIM) -> np.ndarray:
    """The sparse ternary index vector of each bucket."""
    rng = np.random.default_rng(7)
    out = np.zeros((buckets, dim), np.float32)
    for _ in range(NONZERO):
        out[np.arange(buckets), rng.integers(0, dim, buckets)] += rng.choice(np.array([-1, 1], np.float32), buckets)
    return out


def _form(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One pseudo-word for each word: its shape, whether it repeats the one before, its line's length."""
    starts, ends, _ = spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64)
    kinds = np.left_shift(np.uint8(1), _CLASS[data])
    has = np.bitwise_or.reduceat(kinds, np.ravel(np.column_stack([starts, ends]))[:-1])[::2]
    has[ends - starts == 1] = kinds[starts[ends - starts == 1]]
    last = _CLASS[data[ends - 1]]
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[at[:-1][at[:-1] < len(words)]] = False
    lines = np.concatenate([[0], np.cumsum(data == 10)])[starts] + np.repeat(np.arange(len(at) - 1), np.diff(at))  # no line crosses a row
    at_line = runs(lines)
    size = np.diff(np.append(at_line, len(lines)))
    size = np.repeat(np.minimum(np.log2(size + 1), 5).astype(np.uint64), size)
    shape = has.astype(np.uint64) * _U(8) + last
    return mix((shape * _U(2) + again) * _U(64) + size + _U(0x51AFE))


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h % _U(BUCKETS)).astype(np.int64)


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row range, buckets of words, buckets of pseudo-words, index of each row's first word."""
    for first, last, data, offsets in chunks(column, CHUNK):
        words, at = word_hashes(data, offsets)
        yield first, last, _buckets(words), _buckets(_form(data, offsets, words, at)), at


def context_sums(out: np.ndarray, texts: pa.Array) -> None:
    """Random indexing: adds to each bucket's row of ``out`` (integers) its neighbours' index vectors."""
    index = index_vectors().astype(np.int32)
    for _, _, words, form, at in tokens(texts):
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        pairs = [form * BUCKETS + words]
        for k in range(1, WINDOW + 1):
            same = np.flatnonzero(row[:-k] == row[k:]) if len(row) > k else np.zeros(0, int)
            pairs += [words[same] * BUCKETS + words[same + k], words[same + k] * BUCKETS + words[same]]
        key = np.concatenate(pairs)
        if len(key):
            key.sort()
            start = runs(key)
            count = np.diff(np.append(start, len(key))).astype(np.int32)
            bucket, near = key[start] // BUCKETS, key[start] % BUCKETS
            own = runs(bucket)
            out[bucket[own]] += np.add.reduceat(index[near] * count[:, None], own, axis=0)


def context_vectors(rows: DataFrame) -> np.ndarray:
    """The normalised context vectors over the column ``text``, summed in tasks.

    Each task makes one partial sum, cut into slices of buckets that are merged by slice. The sums are of
    integers, so the vectors are the same however the rows are dealt.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, DIM), np.int64)
        for b in batches:
            context_sums(sums, b.column(0))
        slices = sums.reshape(-1, SLICE * DIM)
        used = np.flatnonzero(slices.any(axis=1))
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array([slices[i].tobytes() for i in used], pa.binary())], ["slice", "sums"])

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(SLICE * DIM, np.int64)
        for x in group.column("sums"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"slice": group.column("slice")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    kinds = "slice long, sums binary"
    out = np.zeros((BUCKETS // SLICE, SLICE * DIM))
    for r in rows.select("text").mapInArrow(lean(part), kinds).groupBy("slice").applyInArrow(merge, kinds).collect():  # the one matrix
        out[r["slice"]] = np.frombuffer(r["sums"], np.int64)
    out = out.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norm, 1e-6)).astype(np.float32)


def features(column: pa.Array, context: np.ndarray) -> np.ndarray:
    """Pooled vectors of each row; an empty text has zeros."""
    index = index_vectors()
    table = np.concatenate([context, index], axis=1)
    out = np.zeros((len(column), 4 * DIM + 1), np.float32)
    for first, last, words, form, at in tokens(column):
        n = np.diff(at)
        if len(words):
            for part, ids in ((0, words), (2 * DIM, form)):
                # the sum of each row's vectors, through counts of its distinct buckets
                key = np.repeat(np.arange(last - first), n) * BUCKETS + ids
                key.sort()
                start = runs(key)
                count = np.diff(np.append(start, len(key))).astype(np.float32)
                row, bucket = key[start] // BUCKETS, key[start] % BUCKETS
                own = runs(row)
                out[first + row[own], part : part + 2 * DIM] = np.add.reduceat(table[bucket] * count[:, None], own, axis=0)
            out[first:last, : 4 * DIM] /= np.maximum(n, 1)[:, None]
        out[first:last, 4 * DIM] = np.log1p(n) / 10
    return out


class Network:
    """A two-layer network with a temperature."""

    def __init__(self, weights: dict[str, np.ndarray], temperature: float):
        self.w, self.temperature = weights, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.w["mean"]) / self.w["std"] @ self.w["a"] + self.w["b"], 0)
        return h @ self.w["c"] + self.w["d"]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    @staticmethod
    def train(x: np.ndarray, y: np.ndarray, seed: int = 1, epochs: int = 60) -> Network:
        """Adam on the logistic loss; every eighth row is kept apart to fit the temperature."""
        rng = np.random.default_rng(seed)
        mean, std = x.mean(0), x.std(0) + 1e-3
        w = {"mean": mean, "std": std, "a": rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)).astype(np.float32), "b": np.zeros(HIDDEN, np.float32), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), "d": np.zeros((), np.float32)}
        net = Network(w, 1.0)
        apart = np.arange(len(y)) % 8 == 7
        z, t = ((x - mean) / std)[~apart], y[~apart].astype(np.float32)
        m = {k: [np.zeros_like(w[k]), np.zeros_like(w[k])] for k in "abcd"}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(t))
            for rows in np.array_split(order, max(1, len(order) // 128)):
                h = np.maximum(z[rows] @ w["a"] + w["b"], 0)
                p = 1 / (1 + np.exp(-np.clip(h @ w["c"] + w["d"], -40, 40)))
                g = ((p - t[rows]) / len(rows)).astype(np.float32)
                back = np.outer(g, w["c"]) * (h > 0)
                grads = {"a": z[rows].T @ back + 1e-3 * w["a"], "b": back.sum(0), "c": h.T @ g + 1e-3 * w["c"], "d": g.sum()}
                step += 1
                for k, gr in grads.items():
                    one, two = m[k]
                    one *= 0.9
                    one += 0.1 * gr
                    two *= 0.999
                    two += 0.001 * gr**2
                    w[k] = w[k] - np.float32(2e-3) * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
        if apart.any():
            out, t = net.logits(x[apart]), y[apart]
            loss = lambda s: float(np.mean(np.logaddexp(0, out / s) - t * out / s))
            net.temperature = min(np.geomspace(0.25, 8, 60).tolist(), key=loss)
        return net


def train(rows: DataFrame) -> tuple[np.ndarray, Network | None]:
    """Word vectors and network from a bounded table of doc_id, text and quality, whose texts stay in tasks."""
    context = context_vectors(rows)
    shared = rows.sparkSession.sparkContext.broadcast(context)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1), shared.value)
            yield pa.record_batch([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    found = rows.select("doc_id", "text", "quality").mapInArrow(lean(pooled), "doc_id long, quality double, x binary").toPandas()
    found = found.sort_values(["doc_id", "x"])  # the same order however the rows are dealt
    if not len(found):
        return context, None
    x = np.frombuffer(b"".join(found["x"]), np.float32).reshape(len(found), -1)
    return context, Network.train(x, found["quality"].to_numpy(float))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled training rows, those with the smallest hashes: a bounded, fixed sample of whole texts.

    Of rows with the same ``doc_id`` the one whose text has the smallest hash is taken.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = marked.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` small rows: bounded
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    # one row for each id, however often it is repeated, and the same one in every run
    one = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return one.select("doc_id", F.col("least.text").alias("text"), F.col("quality").cast("double").alias("quality"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """Scores whole texts: doc_id, held_out, score, predicted (and the columns named in ``keep``).

    Labels are learned from at most ``sample`` labelled rows whose crc32(doc_id) mod 5 is not 0; training
    and scoring read every text whole. Null texts score like empty ones; a null ``doc_id`` has a null ``held_out``. Without usable
    labels every score is 0.5. A document labelled twice has its higher label. Repeated rows are scored
    each, and one of them is learned from; no rows give no rows. Memory: a small matrix and the sample's features on the driver, the matrix and
    a batch on a worker.
    """
    store = _store.Store(docs.sparkSession, "quality")
    context, net = train(store.table(labelled_sample(docs, labels, sample), "sample"))
    store.remove()
    keep = [c for c in keep or [] if c not in ("doc_id", "held_out", "score", "predicted")]
    others = [c for c in keep if c != "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), *[F.col(c).alias(f"_own{i}") for i, c in enumerate(others)])
    shared = docs.sparkSession.sparkContext.broadcast((context, net))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, net = shared.value
        for b in batches:
            s = net.score(features(b.column(1), context)).astype(float) if net else np.full(len(b), 0.5)
            text = [b.column(1)] if "text" in keep else []
            yield pa.record_batch([b.column(0), pa.array(s), *text, *b.columns[2:]], ["_id", "score", *(["text"] if text else []), *others])

    kinds = "".join(f", `{c}` {t}" for c, t in (docs.select(*others).dtypes if others else []))
    out = rows.mapInArrow(lean(score), f"_id long, score double{', text string' if 'text' in keep else ''}{kinds}")
    return out.select(F.col("_id").alias("doc_id"), (F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(5)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *keep)
