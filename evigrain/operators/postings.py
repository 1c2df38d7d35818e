"""A written index for BM25: postings in blocks with their highest impacts, so that a search reads few of them.

A block is a term's postings in one window of documents (some consecutive documents of one task): document numbers as
deltas, term frequencies and lengths, each in as few bytes as the block's largest needs. Beside it stand its peaks:
the pairs of frequency and length that no other pair of the block beats, which bound its score for any mean length.

Blocks are Parquet rows sorted by term within buckets of the term's hash, a folder for each segment: new documents make a
new segment, and :func:`merge` rewrites segments as one. A search takes the blocks of its terms that may score
highest, gets from them a floor for the k-th score, leaves out every window whose bounds can't reach it, and scores the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..scratch import Steps
from .ranking import LISTED_TERMS, query_terms, small, top

WINDOW = 128
BUCKETS = 16
#: Documents whose blocks of one bucket one task sorts and writes.
DEALT = 50_000
#: Blocks of each term whose scores make the floor.
FIRST = 4
_PEAK = "struct<tf:int,length:int>"
_BLOCK = f"term string, window long, n int, peaks array<{_PEAK}>, docs binary, tfs binary, lengths binary"
_TYPES = (np.uint8, np.uint16, np.uint32, np.uint64)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, after a byte that says how many."""
    kind = next(i for i, t in enumerate(_TYPES) if not len(values) or int(values.max()) <= np.iinfo(t).max)
    return bytes([kind]) + values.astype(_TYPES[kind]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, _TYPES[raw[0]], offset=1).astype(np.int64)


def deltas(docs: np.ndarray) -> bytes:
    """Ascending document numbers: the first one, and the packed steps between them."""
    return int(docs[0]).to_bytes(8, "little", signed=True) + packed(np.diff(docs).astype(np.uint64))


def numbers(raw: bytes) -> np.ndarray:
    return int.from_bytes(raw[:8], "little", signed=True) + np.concatenate([[0], np.cumsum(unpacked(raw[8:]))]).astype(np.int64)


def peaks(tf: np.ndarray, length: np.ndarray) -> list[dict]:
    """The pairs that aren't beaten: for a higher frequency a longer document only."""
    order = np.lexsort((length, -tf))
    out, least = [], None
    for f, n in zip(tf[order].tolist(), length[order].tolist(), strict=True):
        if least is None or n < least:
            out.append({"tf": f, "length": n})
            least = n
    return out


def _binary(values: np.ndarray, starts: np.ndarray, first: np.ndarray | None = None) -> pa.Array:
    """:func:`packed` of each stretch of ``values`` (from each start to the next), after eight bytes of ``first`` if given."""
    n, head = np.diff(starts, append=len(values)), 0 if first is None else 8
    most = np.zeros(len(n), np.uint64)
    held = np.flatnonzero(n)
    if len(held):
        # stretches without values don't part the others
        most[held] = np.maximum.reduceat(values, starts[held])
    kind = np.searchsorted(np.array([np.iinfo(t).max for t in _TYPES], np.uint64), most).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(head + 1 + (n << kind))])
    out = np.zeros(int(offsets[-1]), np.uint8)
    if head:
        out[offsets[:-1, None] + np.arange(8)] = first.astype("<i8").view(np.uint8).reshape(-1, 8)
    out[offsets[:-1] + head] = kind
    own = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(values)) - starts[own]
    for k, t in enumerate(_TYPES):
        at = np.flatnonzero(kind[own] == k)
        if len(at):
            to = offsets[own[at]] + head + 1 + (place[at] << k)
            out[to[:, None] + np.arange(1 << k)] = values[at].astype(t).view(np.uint8).reshape(-1, 1 << k)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def _all_peaks(tf: np.ndarray, length: np.ndarray, block: np.ndarray, blocks: int) -> pa.Array:
    """:func:`peaks` of each block, whose numbers ascend."""
    order = np.lexsort((length, -tf, block))
    # a block's lengths lie below those of the blocks before it, so one running minimum serves all
    low = length[order] - block[order] * (int(length.max(initial=0)) + 1)
    kept = order[np.concatenate([[True], low[1:] < np.minimum.accumulate(low)[:-1]])] if len(low) else order
    offsets = np.concatenate([[0], np.cumsum(np.bincount(block[kept], minlength=blocks))])
    pairs = pa.StructArray.from_arrays([pa.array(tf[kept], pa.int32()), pa.array(length[kept], pa.int32())], ["tf", "length"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


def _blocks(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split(" ")[0] for x in ("term string", "window long", "n int", "peaks x", "docs binary", "tfs binary", "lengths binary")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo in range(0, len(b), window):
                part = b.slice(lo, window)
                terms = part.column(1)
                size = np.diff(terms.offsets.to_numpy()).astype(np.int64)
                codes = terms.flatten().dictionary_encode()
                # a row for each document, and the empty term in every one: it counts documents and lengths
                vocabulary = pa.concat_arrays([pa.array([""], codes.dictionary.type), codes.dictionary])
                doc = np.argsort(part.column(0).to_numpy(), kind="stable")
                place = np.empty(len(doc), np.int64)
                place[doc] = np.arange(len(doc))
                pair = (codes.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1) * len(doc) + np.repeat(place, size)
                pair, tf = np.unique(np.concatenate([np.arange(len(doc)), pair]), return_counts=True)
                term, row = np.divmod(pair, len(doc))
                ids, lengths = part.column(0).to_numpy()[doc][row], size[doc][row]
                # all blocks of the window at once: a term has few postings in it
                starts = np.flatnonzero(np.diff(term, prepend=-1))
                n = np.diff(starts, append=len(term))
                block = np.repeat(np.arange(len(n)), n)
                inner = np.ones(len(term), bool)
                inner[starts] = False
                steps = _binary(np.diff(ids, prepend=0)[inner].astype(np.uint64), starts - np.arange(len(n)), ids[starts])
                columns = [vocabulary.take(pa.array(term[starts])), pa.array(np.full(len(n), at)), pa.array(n, pa.int32()), _all_peaks(tf, lengths, block, len(n)), steps]
                yield pa.record_batch([*columns, _binary(tf.astype(np.uint64), starts), _binary(lengths.astype(np.uint64), starts)], names)
                at += 1

    return work


def _write(blocks: DataFrame, folder: str, buckets: int, docs: int) -> None:
    """Writes a segment, then the note that makes it one: a segment without its note is not read.

    A bucket has a file, sorted by term, for every ``DEALT`` documents: what a task sorts doesn't grow with the corpus.
    """
    segment, files = uuid.uuid4().hex, -(-docs // DEALT) or 1
    dealt = blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    dealt.repartition(buckets * files, "bucket", F.pmod(F.xxhash64("window"), F.lit(files))).sortWithinPartitions("bucket", "term", "window").write.partitionBy("bucket").parquet(f"{folder}/blocks/segment={segment}")
    spark = blocks.sparkSession
    every = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks/segment={segment}").where("term = ''").select("term", "docs", "tfs", "lengths")
    note = _postings(every).agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"))
    note.select(F.lit(segment).alias("name"), "docs", "words").coalesce(1).write.mode("append").parquet(f"{folder}/segments")


def segments(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """Name, documents and words of each segment."""
    return [tuple(r) for r in spark.read.schema("name string, docs long, words long").parquet(f"{folder}/segments").collect()]


def add(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", analyse: Callable[[Column], Column] = words, window: int = WINDOW, buckets: int = BUCKETS) -> None:
    """Adds documents (whole-number ids that the index doesn't have yet) as a segment. Null texts are empty; rows without an id are left out.

    One pass makes the blocks in the tasks that read the documents; blocks alone are shuffled. Memory: one
    Arrow batch of terms.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), analyse(F.coalesce(text, F.lit(""))).alias("terms"))
    _write(rows.mapInArrow(_blocks(window), _BLOCK), folder, buckets, rows.count())


def blocks(spark: SparkSession, folder: str, known: list[str] | None = None) -> DataFrame:
    """The blocks of all segments (or those ``known``): the columns of a block, and segment and bucket."""
    known = [name for name, *_ in segments(spark, folder)] if known is None else known
    shape = f"{_BLOCK}, segment string, bucket int"
    if not known:
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).option("basePath", f"{folder}/blocks").parquet(*[f"{folder}/blocks/segment={s}" for s in known])


def merge(spark: SparkSession, folder: str, into: str, window: int = WINDOW, buckets: int = BUCKETS) -> None:
    """Writes the index of ``folder`` as one segment of the new index ``into``; small windows are put together.

    Windows of several segments are joined until they hold ``window`` documents; a term's blocks in them become one.
    Readers of the old index keep it until it is removed.
    """
    rows = blocks(spark, folder)
    sizes = rows.where("term = ''").select("segment", "window", "n")
    # sums run within slices of the windows, so that no task has them all
    order = "partition by _slice order by segment, window rows between unbounded preceding and 1 preceding"
    sliced = sizes.withColumn("_slice", F.pmod(F.xxhash64("segment", F.shiftright("window", 12)), F.lit(64)))
    placed = sliced.withColumn("_before", F.coalesce(F.expr(f"sum(n) over ({order})"), F.lit(0)))
    placed = placed.select("segment", "window", (F.col("_slice").cast("long") * (1 << 40) + F.floor(F.col("_before") / window)).alias("_new"))
    moved = rows.join(placed, ["segment", "window"])

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        docs, tfs, lengths = (np.concatenate([f(x) for x in table[c].to_pylist()]) for c, f in (("docs", numbers), ("tfs", unpacked), ("lengths", unpacked)))
        order = np.argsort(docs, kind="stable")
        docs, tfs, lengths = docs[order], tfs[order], lengths[order]
        kind = pa.list_(pa.struct([("tf", pa.int32()), ("length", pa.int32())]))
        return pa.table({"term": [key[0].as_py()], "window": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([len(docs)], pa.int32()), "peaks": pa.array([peaks(tfs, lengths)], kind), "docs": [deltas(docs)], "tfs": [packed(tfs)], "lengths": [packed(lengths)]})

    made = moved.select("term", F.col("_new").alias("window"), "docs", "tfs", "lengths").groupBy("term", "window").applyInArrow(joined, _BLOCK)
    _write(made, into, buckets, sum(n for _, n, _ in segments(spark, folder)))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [[f(x) for x in b[c].to_pylist()] for c, f in (("docs", numbers), ("tfs", unpacked), ("lengths", unpacked))]
        n = [len(x) for x in parts[0]]
        flat = [pa.array(np.concatenate(p) if p else np.zeros(0, np.int64), pa.int64()) for p in parts]
        yield pa.record_batch([b["term"].take(pa.array(np.repeat(np.arange(len(b)), n))), *flat], ["term", "doc", "tf", "length"])


def _postings(rows: DataFrame) -> DataFrame:
    return rows.select("term", "docs", "tfs", "lengths").mapInArrow(_decoded, "term string, doc long, tf long, length long")


class Search:
    """A search over a written index: ``results`` of each query, and ``read``: how many of its blocks were scored."""

    def __init__(self, spark: SparkSession, folder: str, queries: DataFrame, k: int, analyse: Callable[[Column], Column] = words, k1: float = 1.2, b: float = 0.75, key: str = "doc_id"):
        known = segments(spark, folder)
        n, total = sum(x for _, x, _ in known), sum(x for *_, x in known)
        mean = total / n if total else 1.0
        terms = query_terms(queries, analyse)
        asked = terms.limit(LISTED_TERMS + 1).collect()
        rows = blocks(spark, folder, [name for name, *_ in known])
        listed = len(asked) <= LISTED_TERMS
        if listed:
            # in a local relation, whose size is known, and as a list that reaches the scan: row groups are sorted by term
            terms = spark.createDataFrame([tuple(r) for r in asked], "query_id long, term string" if not asked else terms.schema)
            rows = rows.where(F.col("term").isin(sorted({r.term for r in asked})))
        else:
            rows = rows.join(small(terms.select("term").distinct()), "term", "left_semi")
        near = F.broadcast if listed else lambda df: df
        counts = rows.groupBy("term").agg(F.sum("n").alias("df"))
        if listed:
            counts = spark.createDataFrame([tuple(r) for r in counts.collect()], "term string, df long")
        else:
            counts = Steps(spark, "search").write(counts, "counts")
        weights = terms.join(near(counts), "term").withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).drop("df")

        def part(tf: Column, length: Column) -> Column:
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean)))

        def scored(found: DataFrame) -> DataFrame:
            each = found.join(near(weights), "term").select("query_id", "doc", (F.col("idf") * part(F.col("tf"), F.col("length"))).alias("s"))
            return each.groupBy("query_id", "doc").agg(F.sum("s").alias("score"), F.count("*").alias("n_terms"))

        bound = F.array_max(F.transform("peaks", lambda p: part(p["tf"], p["length"]))) * F.col("idf")
        bounds = rows.join(near(weights), "term").select("query_id", "segment", "window", "term", bound.alias("bound"))
        first = top(bounds, FIRST, [F.desc("bound"), F.asc("segment"), F.asc("window")], ["query_id", "term"]).select("segment", "window").distinct()
        # FIRST windows a term at most
        floor = top(scored(_postings(rows.join(near(first), ["segment", "window"], "left_semi"))), k, [F.desc("score")], ["query_id"])
        floor = floor.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("floor"))
        reach = bounds.groupBy("query_id", "segment", "window").agg(F.sum("bound").alias("bound"), F.count("*").alias("blocks")).join(near(floor), "query_id", "left")
        # a hair below, as sums of the same numbers in another order differ
        reach = reach.withColumn("open", F.coalesce(F.col("bound") >= F.col("floor") * (1 - 1e-9) - 1e-9, F.lit(True)))
        # written, as it is looked at first and then joined
        left = Steps(spark, "search").write(reach.where("open").select("segment", "window").distinct(), "left")
        some = left.limit(LISTED_TERMS + 1).collect()
        wanted = rows
        if len(some) <= LISTED_TERMS:
            # pages are sorted by window within a term
            wanted = wanted.where(F.col("window").isin(sorted({r.window for r in some})))
            left = F.broadcast(spark.createDataFrame([tuple(r) for r in some], "segment string, window long"))
        found = top(scored(_postings(wanted.join(left, ["segment", "window"], "left_semi"))).withColumn("score", F.round("score", 6)), k, [F.desc("score"), F.asc("doc")], ["query_id"])
        self.results = found.select("query_id", F.col("doc").alias(key), "n_terms", "score", "rank")
        self.read = reach.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.coalesce(F.sum(F.when(F.col("open"), F.col("blocks"))), F.lit(0)).alias("read"))
