"""Near-duplicate documents on word shingles.

Method: one-permutation hashing splits a document's shingle hashes into bins and keeps each bin's least
value; empty bins are filled by optimal densification (each draws other bins by its own hash sequence
until one has a value). Rows of bins make bands, and documents with an equal band share a bucket. Within a
bucket every document meets two centres, so a bucket of n documents gives about 2 n candidates, not n * n,
and of all its centres a document is compared with those that it is nearest to. Candidates are confirmed on
full shingle sets and joined to components by alternating star contractions.

A star alone could miss a link between two documents that both differ from the centre. So the members of
buckets that still hold several components are searched again. Those that can have no partner go first: of
two sets that are alike enough, the few shingles of each that come first in one common order share one. The
order is by how many of these members hold a shingle, rarest first, so a template's shingles come last. Of
those left, members outside a bucket's main component meet the members of others, bounded by sizes and by
bitmaps (parities of hashed shingles, so two bitmaps differ in no more bits than the sets do in shingles).
No bound ever parts a true pair.

Equal sets are collapsed before all this, so exact copies cost one row. No key gathers its rows in one task: a
class of very many copies meets its rows by a broadcast of such keys alone (each has a stated share of all rows,
so they are few), a vertex's least neighbour is looked up in arrays where its links lie, a centre's full set meets
by blocks of its links; empty sets take no part in any join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import _store
from ._memory import lean
from ._text import combine, mix, shingle_sets

BINS = 256
BANDS = 42
ROWS = 6
_U = np.uint64
_SHIFT = _U(56)  # the bin is the top 8 bits
_DRAWS = 512
_DRAW = (mix(np.arange(BINS * _DRAWS, dtype=np.uint64) + _U(0xABCDEF)) >> _SHIFT).astype(np.int64).reshape(BINS, _DRAWS)
_EDGES = np.arange(BINS, dtype=np.uint64) << _SHIFT
BITMAP_WORDS = 16
CENTRES = 2
WANTED_IDS = 4_000_000
SLOTS = 1 << 20
MOST_SLOTS = 1 << 26
FLUSH = 1 << 21
GROUP = 2000
HOT = 10_000
ARRAY_LINKS = 1 << 20
LEAST_SHARDS = 8
_BAND = mix(np.arange(BANDS, dtype=np.uint64) + _U(77))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of sorted distinct shingle hashes (not empty)."""
    at = np.searchsorted(shingles, _EDGES)
    full = np.diff(np.append(at, len(shingles))) > 0
    out = np.zeros(BINS, np.uint64)
    out[full] = shingles[at[full]]
    empty = np.flatnonzero(~full)
    for lo, hi in ((0, 8), (8, 64), (64, _DRAWS)):
        if not len(empty):
            return out
        hits = full[_DRAW[empty, lo:hi]]
        found = hits.any(axis=1)
        done = empty[found]
        out[done] = out[_DRAW[done, lo + hits[found].argmax(axis=1)]]
        empty = empty[~found]
    if len(empty):  # only for a handful of full bins: the next full one, around the ring
        bins = np.flatnonzero(full)
        out[empty] = out[bins[np.searchsorted(bins, empty) % len(bins)]]
    return out


def bands(sign: np.ndarray) -> np.ndarray:
    """One hash for each band."""
    rows = sign[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = _BAND.copy()
    for k in range(ROWS):
        key = combine(key, rows[:, k])
    return key


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each of 64 * ``BITMAP_WORDS`` places."""
    n = 64 * BITMAP_WORDS
    odd = np.bincount((shingles & _U(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """Each document's set size, 128-bit set hash and bands (null for an empty set)."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, one, two, keys, maps = np.zeros(len(b), np.int64), np.zeros(len(b), np.uint64), np.zeros(len(b), np.uint64), [], []
            for r, s in shingle_sets(b.column(1), width):
                sizes[r] = len(s)
                if len(s):
                    h = xxhash.xxh3_128_intdigest(s)
                    one[r], two[r] = h >> 64, h & (2**64 - 1)
                    keys.append(bands(signature(s)).tobytes())
                    maps.append(bitmap(s))
                else:
                    keys.append(None)
                    maps.append(None)
            yield pa.record_batch([b.column(0), pa.array(sizes), _signed(one), _signed(two), pa.array(keys, pa.binary()), pa.array(maps, pa.list_(pa.int64()))], ["doc_id", "n", "h1", "h2", "bands", "bits"])

    return docs.mapInArrow(lean(profile), "doc_id long, n long, h1 long, h2 long, bands binary, bits array<long>")


def _buckets(classes: DataFrame) -> DataFrame:
    """One row per class and band: key, class, set size."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 2000):
                c = b.slice(lo, 2000)
                keys = np.frombuffer(b"".join(c.column(2).to_pylist()), np.int64)
                ids, sizes = (np.repeat(c.column(k).to_numpy(), BANDS) for k in (0, 1))
                yield pa.record_batch([pa.array(keys), pa.array(ids), pa.array(sizes)], ["key", "id", "n"])

    return classes.select("id", "n", "bands").mapInArrow(lean(spread), "key long, id long, n long")


def _wanted(rows: DataFrame, store: _store.Store, name: str) -> list[str]:
    """Writes distinct ids, and other whole numbers beside them, as arrays in order of ids, dealt by remainder; returns the files."""
    rows = store.table(rows.distinct(), name)
    shards, folder, columns = _store.cut(rows.count(), WANTED_IDS), store.uri, rows.columns

    def write(key: tuple, part: pa.Table) -> pa.Table:
        order = np.argsort(part["id"].to_numpy())
        path = _store.write_arrays(f"{folder}/{name}-arrays", f"s{key[0].as_py()}", {c: part[c].to_numpy()[order] for c in columns})
        return pa.table({"shard": [key[0].as_py()], "path": [path]})

    made = rows.withColumn("shard", F.pmod("id", F.lit(shards)).cast("long")).groupBy("shard").applyInArrow(write, "shard long, path string")
    files = dict(store.table(made, f"{name}-files").collect())
    return [files.get(i, "") for i in range(shards)]


def _among(ids: np.ndarray, files: list[str], field: str = "id") -> tuple[np.ndarray, np.ndarray]:
    """Which ids are in the arrays, and the numbers of ``field`` beside them."""
    found, out = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
    shard = ids % len(files)
    for s in np.unique(shard).tolist():
        if files[s]:
            arrays, rows = _store.open_arrays(files[s]), np.flatnonzero(shard == s)
            at = np.minimum(np.searchsorted(arrays["id"], ids[rows]), len(arrays["id"]) - 1)
            found[rows], out[rows] = arrays["id"][at] == ids[rows], arrays[field][at]
    return found, out


def _sets(docs: DataFrame, width: int, files: list[str]) -> DataFrame:
    """The full sets of the documents whose ids are in the arrays: texts are probed where they lie, not joined."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(_among(b.column(0).to_numpy(), files)[0]))
            ids, out, size = [], [], 0
            numbers = b.column(0).to_pylist()
            for r, s in shingle_sets(b.column(1), width):
                ids.append(numbers[r])
                out.append(s.tobytes())
                size += len(out[-1])
                if size > 8 << 20:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "shingles"])
                    ids, out, size = [], [], 0
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "shingles"])

    return docs.where("doc_id is not null").mapInArrow(lean(full), "id long, shingles binary")


def _frequencies(sets: DataFrame, files: list[str], slots: int, store: _store.Store) -> list[str]:
    """How many of the sets in question hold the shingles of each slot (a slot is a shingle hash modulo ``slots``), as arrays of ``SLOTS`` slots."""

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            x = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            return pa.record_batch([pa.array(x[at]), pa.array(np.diff(np.append(at, len(x))))], ["slot", "n"])

        for b in batches:
            for s in b.filter(pa.array(_among(b.column(0).to_numpy(), files)[0])).column(1):
                held.append((np.frombuffer(s.as_buffer(), np.uint64) % _U(slots)).astype(np.int64))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    folder = store.uri

    def write(key: tuple, part: pa.Table) -> pa.Table:
        n = np.zeros(SLOTS, np.uint32)
        n[part["slot"].to_numpy() % SLOTS] = np.minimum(part["n"].to_numpy(), 2**32 - 1)
        return pa.table({"shard": [key[0].as_py()], "path": [_store.write_arrays(f"{folder}/slot-arrays", f"s{key[0].as_py()}", {"n": n})]})

    summed = sets.mapInArrow(lean(slots_of), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    made = summed.withColumn("shard", F.floor(F.col("slot") / SLOTS)).groupBy("shard").applyInArrow(write, "shard long, path string")
    found = dict(store.table(made, "slot-files").collect())  # at most MOST_SLOTS / SLOTS rows
    return [found.get(i, "") for i in range(-(-slots // SLOTS))]


def _prefixes(sets: DataFrame, files: list[str], slots: int, counts: list[str], percent: int) -> DataFrame:
    """Of each set in question the shingles that come first, rarest first: shingle, id, root, n.

    A set of n shares at least ``percent`` % of its own n with any set alike enough, so one of its first
    n - ceil(n * percent / 100) + 1 is among the other's first ones as well.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_store.open_arrays(c)["n"] if c else np.zeros(SLOTS, np.uint32) for c in counts]
        for b in batches:
            found, roots = _among(b.column(0).to_numpy(), files, "root")
            rows = np.flatnonzero(found)
            keys, ids, own, sizes, held = [], [], [], [], 0
            for r in rows.tolist():
                s = np.frombuffer(b.column(1)[r].as_buffer(), np.uint64)
                slot = (s % _U(slots)).astype(np.int64)
                often = np.empty(len(s), np.uint32)
                for k in np.unique(slot // SLOTS).tolist():
                    at = slot // SLOTS == k
                    often[at] = tables[k][slot[at] % SLOTS]
                take = len(s) - -(-len(s) * percent // 100) + 1
                keys.append(s[np.lexsort((s, often))[:take]])
                for out, x in ((ids, b.column(0)[r].as_py()), (own, int(roots[r])), (sizes, len(s))):
                    out.append(np.full(take, x, np.int64))
                held += take
                if held >= FLUSH // 8:
                    yield _prefix_rows(keys, ids, own, sizes)
                    keys, ids, own, sizes, held = [], [], [], [], 0
            if held:
                yield _prefix_rows(keys, ids, own, sizes)

    return sets.mapInArrow(lean(first), "shingle long, id long, root long, n long")


def _prefix_rows(keys: list[np.ndarray], *others: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([_signed(np.concatenate(keys)), *(pa.array(np.concatenate(x)) for x in others)], ["shingle", "id", "root", "n"])


def _partnered(at: DataFrame, sets: DataFrame, store: _store.Store, percent: int) -> DataFrame:
    """The ids of the members in question (id, root, n) that share a first shingle with a member of another root.

    The others can't be alike to any. Linear in the members' sets: no pairs are made.
    """
    files = _wanted(at.select("id", "root"), store, "members-in-question")
    total = at.agg(F.sum("n")).first()[0] or 0
    slots = 1 << (_store.cut(total, 4, SLOTS, MOST_SLOTS) - 1).bit_length()
    rows = store.table(_prefixes(sets, files, slots, _frequencies(sets, files, slots, store), percent), "prefixes")
    shared = rows.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("shingle")
    return rows.join(shared, "shingle", "left_semi").select("id").distinct()


def _missed(at: DataFrame, sets: DataFrame, bits: DataFrame, store: _store.Store, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket with different roots that may be alike: none that is alike is left out.

    ``at`` has the members of mixed buckets: key, id, root, n. Members outside a bucket's main component meet
    its other members; a large bucket's are dealt out in blocks, so that no task has all its pairs.
    """
    live = _partnered(at.select("id", "root", "n").distinct(), sets, store, percent)
    at = store.table(at.select("key", "id", "root").join(live, "id"), "live")
    of_root = at.groupBy("key", "root").agg(F.count("*").alias("k"))
    groups = of_root.groupBy("key").agg(F.sum("k").alias("k"), F.max(F.struct("k", F.col("root").alias("main"))).alias("top"), F.count("*").alias("roots"))
    groups = groups.where("roots > 1").select("key", F.ceil(F.col("k") / GROUP).cast("int").alias("blocks"), F.col("top.main").alias("main"))
    rows = at.join(groups, "key").join(bits, "id")
    ends = lambda df, x: _side(df, x, "key", F.col("root").alias(f"r{x}"), "block")
    few = ends(rows.where("root <> main").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")), "b")
    every = ends(rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "a")
    pairs = few.join(every, ["key", "block"]).where((F.col("ra") != F.col("rb")) & _sizes_fit(percent) & _bitmaps_fit(percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _share(rows: int) -> int:
    """How many of ``rows`` rows one key may have in a task. Fewer than ``HOT`` keys have more."""
    return max(GROUP, -(-rows // HOT))


def _joined(many: DataFrame, one: DataFrame, key: list[str], share: int) -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key with the number ``k`` of its rows in ``many``.

    Keys with more than ``share`` rows meet where their rows lie: their rows of ``one`` are broadcast.
    """
    few = F.broadcast(one.where(F.col("k") > share).drop("k"))
    rest = many.join(few.select(*key), key, "left_anti").join(one.where(F.col("k") <= share).drop("k"), key)
    return rest.unionByName(many.join(few, key))


def _with_sets(rows: DataFrame, sets: DataFrame, pairs: DataFrame, end: str, other: str, share: int) -> DataFrame:
    """``rows`` of ``pairs`` with the full set of one end, ``s`` and its name. An end of many pairs is dealt out in blocks of them."""
    ends = pairs.groupBy(end).agg(F.count("*").alias("k")).where(F.col("k") > share)
    blocks = F.broadcast(ends.select(end, F.ceil(F.col("k") / share).cast("int").alias("blocks")))
    own = sets.withColumnsRenamed({"id": end, "shingles": f"s{end}"}).join(blocks, end, "left")
    own = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    dealt = rows.join(blocks, end, "left")
    return dealt.withColumn("block", F.pmod(F.xxhash64(other), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks").join(own, [end, "block"]).drop("block")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, whose full sets reach the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(len(b), bool)
            last, x = None, None
            for i in range(len(b)):
                left = b.column(2)[i].as_buffer()
                if last is None or left != last:
                    last, x = left, np.frombuffer(left, np.uint64)
                y = np.frombuffer(b.column(3)[i].as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int(np.count_nonzero(large[at] == small))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["a", "b"])

    share = _share(pairs.count())
    both = _with_sets(_with_sets(pairs, sets, pairs, "b", "a", share), sets, pairs, "a", "b", share)
    return both.select("a", "b", "sa", "sb").mapInArrow(lean(check), "a long, b long")


def _both(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([u, v]), np.concatenate([v, u])


def _combined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each ``u`` once, in order, with its least ``v``."""
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    at = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
    return u[at], v[at]


def _least(links: DataFrame, step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], shards: int, folder: str) -> list[str]:
    """Each ``u`` of the links that ``step`` makes of a batch (u, v), with its least ``v``, as arrays dealt by remainder; returns the files.

    A batch's links are combined before they move, so a vertex of very many links is a row a batch.
    """

    def combine_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = _combined(*step(b.column(0).to_numpy(), b.column(1).to_numpy()))
            yield pa.record_batch([pa.array(u % shards), pa.array(u), pa.array(v)], ["shard", "u", "v"])

    def write(key: tuple, part: pa.Table) -> pa.Table:
        u, v = _combined(part["u"].to_numpy(), part["v"].to_numpy())
        return pa.table({"shard": [key[0].as_py()], "path": [_store.write_arrays(folder, f"s{key[0].as_py()}", {"id": u, "least": v})]})

    made = links.select("u", "v").mapInArrow(lean(combine_batch), "shard long, u long, v long").groupBy("shard").applyInArrow(write, "shard long, path string")
    files = dict(made.collect())  # a row for each shard
    return [files.get(i, "") for i in range(shards)]


def _large(files: list[str]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The large star: larger neighbours of each vertex are linked to the least of it and its neighbours."""

    def step(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = _both(u, v)
        u, v = u[v > u], v[v > u]
        least = np.minimum(_among(u, files, "least")[1], u)
        return v, least  # the least is never the larger end itself

    return step


def components(edges: DataFrame, store: _store.Store, name: str) -> DataFrame:
    """Connected components of links (a, b): id, root (the smallest id). Only linked ids have a row.

    Alternates the large and the small star until a round changes nothing. Least neighbours are written as arrays and
    probed where the links lie, so links of one vertex stay dealt out, and a round has three exchanges: a driver keeps
    threads, plans and tasks of each. The driver sees the arrays' names and two numbers a round.
    """
    shape = "u long, v long"

    def written(df: DataFrame, k: int) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = store.table(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")), f"{name}-{k}")
        return out, (seen.get["n"], seen.get["sum"])

    now, before = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), 0)
    for k in count(1):
        if not before[0]:
            break
        shards, folder = _store.cut(before[0], ARRAY_LINKS, LEAST_SHARDS), f"{store.uri}/{name}-least"
        large = _large(_least(now, _both, shards, folder))
        files = _least(now, large, shards, folder)

        def small(batches: Iterator[pa.RecordBatch], large=large, files=files) -> Iterator[pa.RecordBatch]:
            for b in batches:
                u, v = large(b.column(0).to_numpy(), b.column(1).to_numpy())
                least = _among(u, files, "least")[1]
                u, v = np.concatenate([u, v]), np.concatenate([least, least])
                yield pa.record_batch([pa.array(u[u > v]), pa.array(v[u > v])], ["u", "v"])

        now, after = written(now.select("u", "v").mapInArrow(lean(small), shape).distinct(), k)
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` % or more.

    ``docs`` needs ``doc_id`` and ``text``; other columns are left out. A set holds the distinct
    ``width``-word shingles of the whole text; fewer words make one shingle of all of them. Texts that are
    null, empty or without words have an empty set and are linked with nothing. Returns doc_id, n_shingles,
    component_id (the smallest doc_id reachable, itself included) and kept (doc_id = component_id), one row
    for each row of ``docs``. Repeated rows share their component. Rows with the same ``doc_id`` and other
    texts are linked each by its own text, and where that ``doc_id`` is the smallest of both groups, the
    groups are one. A row with a null ``doc_id`` has a null component, is kept, and links nothing. No rows
    give no rows.

    The bands miss a pair of exactly 80 % with a chance of (1 - 0.8 ** 6) ** 42 < 3e-6.
    """
    spark = docs.sparkSession
    store = _store.Store(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = store.table(_profiles(docs, width), "profiles")
    named = profiles.where("n > 0 and doc_id is not null")
    # classes of equal sets; their bands are equal too
    classes = store.table(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.count("*").alias("k")), "classes")
    buckets = _buckets(classes)
    # two centres a bucket: the smallest id, and one that differs from bucket to bucket
    centres = [F.min("id").alias("centre"), F.max("id").alias("other"), F.min_by("id", F.xxhash64("id", "key")).alias("second")]
    shared = buckets.groupBy("key").agg(*centres).where("centre < other").select("key", "centre", "second")
    members = store.table(buckets.join(shared, "key"), "members")
    bits = classes.select("id", "n", *[F.col("bits")[i].alias(f"w{i}") for i in range(BITMAP_WORDS)])

    # first each member against the centres that its bitmap is nearest to
    star = members.select("id", F.explode(F.array_distinct(F.array("centre", "second"))).alias("centre")).where("id <> centre").distinct()
    star = star.withColumnsRenamed({"id": "b", "centre": "a"}).join(_side(bits, "b"), "b").join(_side(bits, "a"), "a")
    star = star.where(_sizes_fit(percent) & _bitmaps_fit(percent))
    best = Window.partitionBy("b").orderBy(_differ() - F.least("na", "nb"), "a")
    star = star.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= CENTRES).select("a", "b")
    sets = store.table(_sets(docs, width, _wanted(members.select("id"), store, "wanted")), "sets")
    links = store.table(_confirm(store.table(star, "star"), sets, percent), "links-0")
    roots = components(links, store, "roots-0")

    # then the rest: members of buckets that hold several components
    at = store.table(members.select("key", "id", "n").join(roots, "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root")), "placed")
    mixed = at.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    at = at.join(mixed, "key")
    rest = store.table(_missed(store.table(at, "in-question"), sets, bits, store, percent), "rest")
    more = store.table(_confirm(rest, sets, percent), "links-1")
    # what is known is a star for each component already
    roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more), store, "roots-1") if more.limit(1).count() else roots
    # a row of ``found`` for each class, for its documents; documents of hot classes stay where they lie
    found = classes.select("h1", "h2", "id", "k").join(roots, "id", "left").select("h1", "h2", F.coalesce("root", "id").alias("component_id"), "k")
    found = store.table(found, "found")
    share = _share(profiles.count())
    store.keep_only("profiles", "found")
    rows = profiles.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = _joined(rows.where(linked), found, ["h1", "h2"], share).select("doc_id", "n_shingles", "component_id")
    out = out.union(rows.where(~linked).select("doc_id", "n_shingles", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sizes_fit(percent: int):
    """Sets whose sizes differ more can't be that similar."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _side(df: DataFrame, x: str, *more) -> DataFrame:
    """The columns of one end of a pair: id, size, bitmap, and those in ``more``."""
    return df.select(*more, F.col("id").alias(x), F.col("n").alias(f"n{x}"), *[F.col(f"w{i}").alias(f"{x}{i}") for i in range(BITMAP_WORDS)])


def _differ():
    """Bits in which the bitmaps of ``a`` and ``b`` differ."""
    return sum(F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(BITMAP_WORDS))


def _bitmaps_fit(percent: int):
    """Twice the shared shingles are at most both sizes less the bits in which the bitmaps differ."""
    both = F.col("na") + F.col("nb")
    shared = both - _differ()  # twice what is shared, at most
    return 100 * shared >= percent * (2 * both - shared)
