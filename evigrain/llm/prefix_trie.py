"""The trie of the prefixes that conversations share.

Method: conversations are sorted by the sequence of their turns' hashes; the LCP array holds how many turns
neighbours share. Its Cartesian tree is the trie: an element with its nearest smaller values on both sides
spans one node, elements of equal LCP in one span are the same node, and a node stands for all the depths
down from its parent. Counts, smallest members, leaves and savings are sums over the spans.

Scale: sorted conversations are dealt by range, so that copies of one conversation spread over blocks. Nearest
smaller values are found within each block; spans that leave a block find the block where they begin through
the blocks' minima (one number a block), leave one partial row for each depth and block they cross, and are
summed by (first block, depth). Texts are hashed in the scan and never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _store
from ._memory import lean

WIDTH = 16
BLOCK = 400_000
SMALL = 5_000
CHUNK = 1024
EMPTY = hashlib.sha256().hexdigest()
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PARTS = "first long, depth long, pid long, part long, n long, low long, shared long, leaves long, equal long, ends long, ids string"
_SUMS = ("n", "shared", "leaves", "equal", "ends")


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Each conv_id's turns after its first conversation of ``group`` lent it the first h ones: conv_id, key, words.

    h is crc32 of the id modulo ``heads``; the conversation keeps its own turns after its first h. ``key`` is
    the 16-byte hashes of role and text, one after the other; ``words`` the words of each turn. Turns stand by turn (nulls first),
    ties by hash. Rows without a conv_id are left out; null roles and texts are empty. An id's turns meet in one
    row of 16 bytes and a count each: 2 GB hold 100 million turns.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    narrow = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("timed"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("t"),
        F.unhex(F.md5(F.concat_ws(":", F.octet_length(part("role")), part("role"), part("text")))).alias("h"), F.regexp_count(part("text"), F.lit(r"[^\x20\x09-\x0D]+")).alias("w"),
    )
    own = narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("timed", "t", "h", "w"))).alias("own"))
    lent = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_from"), F.slice("own", 1, heads - 1).alias("_lent"))
    own = own.withColumns({"_from": F.col("conv_id") - F.col("conv_id") % group, "_h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")})
    both = own.join(lent, "_from", "left")
    none = F.slice("own", 1, 0)
    all_ = F.concat(F.slice(F.coalesce("_lent", none), F.lit(1), F.col("_h")), F.slice("own", F.col("_h") + 1, F.greatest(F.size("own"), F.lit(1))))
    made = both.select("conv_id", all_.alias("a"))
    key = F.unhex(F.array_join(F.transform("a", lambda x: F.hex(x["h"])), ""))
    return made.select("conv_id", key.alias("key"), F.transform("a", lambda x: x["w"]).alias("words"))


def shared(a: bytes, b: bytes) -> int:
    """How many turns two keys have in common at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = (np.frombuffer(k, np.uint8, n) for k in (a, b))
    return int(np.argmax(x != y)) // WIDTH


def nearest_smaller(values: list[int], ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each element but the first: the place of the nearest smaller value before it (-1: none), the smallest
    id from there to the element, and the first element of the same value that nothing smaller parts from it.

    ``ids[i]`` belongs to the gap between elements i and i + 1.
    """
    n = len(values)
    before, low, same = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.arange(n)
    open_: list[tuple[int, int]] = [(0, 0)]
    for j in range(1, n):
        v, least, first = values[j], ids[j - 1], j
        while open_ and values[open_[-1][0]] >= v:
            i, own = open_.pop()
            if i:
                least = min(least, own)
                if values[i] == v:
                    first = int(same[i])
        before[j], low[j], same[j] = open_[-1][0] if open_ else -1, least, first
        open_.append((j, least))
    return before, low, same


class Block:
    """Sorted conversations with what each shares with the one before; ``left`` and ``right`` at the borders."""

    def __init__(self, table: pa.Table, left: int, right: int):
        table = table.sort_by("pos").combine_chunks()
        self.keys = table["key"].to_pylist()
        self.ids = table["conv_id"].to_numpy()
        self.size = m = len(self.keys)
        self.length = np.array([len(k) // WIDTH for k in self.keys], np.int64)
        self.lcp = np.array([left, *map(shared, self.keys, self.keys[1:]), right], np.int64)
        words = table["words"].chunk(0).flatten().to_numpy(zero_copy_only=False) if m else np.zeros(0)
        total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        self.total = total
        self.shared = self.words_to(np.arange(m), np.maximum(self.lcp[:m], 0))
        self.leaf = (self.lcp[1:] < self.length).astype(np.int64)
        self.run = np.ones(m, np.int64)
        for i in np.flatnonzero((self.lcp[1:m] == self.length[:-1]) & (self.length[1:] == self.length[:-1]))[::-1].tolist():
            self.run[i] = self.run[i + 1] + 1
        self.sum_shared, self.sum_leaf = (np.concatenate([[0], np.cumsum(x)]) for x in (self.shared, self.leaf))
        self.least = int(self.lcp[:m].min())

    def words_to(self, rows: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of the first ``depth`` turns of these conversations."""
        return self.total[self.first[rows] + depth] - self.total[self.first[rows]]

    def left_parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The spans that come in over the left border: depth, end (not included), elements of that LCP."""
        least = np.minimum.accumulate(self.lcp[: self.size])
        depth = np.arange(self.lcp[0] + 1)
        end = np.searchsorted(-least, -depth, "right")
        equal = np.bincount(least[self.lcp[: self.size] == least].clip(0), minlength=len(depth))[: len(depth)]
        return depth, end, equal if len(depth) else depth

    def right_parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The spans that begin here and go on over the right border: depth, begin, elements of that LCP."""
        own = self.lcp[: self.size]
        least = np.minimum.accumulate(own[::-1])[::-1]
        depth = np.arange(self.least + 1, self.lcp[-1] + 1)
        begin = np.searchsorted(least, depth, "left") - 1
        equal = np.bincount(own[(own == least) & (own >= 0)], minlength=self.lcp[-1] + 1)[depth] if len(depth) else depth
        return depth, begin, equal

    def ends_at(self, rows: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """How many conversations end at the node of this depth that begins with these rows."""
        return np.where(self.length[rows] == depth, self.run[rows], 0)

    def ids_hash(self, row: int, count: int) -> str:
        return hashlib.sha256(",".join(map(str, self.ids[row : row + count].tolist())).encode()).hexdigest()


def _measured(key: tuple, table: pa.Table) -> pa.Table:
    """A block's first and last key and the least LCP within it."""
    keys = table.sort_by("pos")["key"].to_pylist()
    inner = min(map(shared, keys, keys[1:]), default=1 << 40)
    return pa.table({"pid": [key[0].as_py()], "first": pa.array([keys[0]], pa.binary()), "last": pa.array([keys[-1]], pa.binary()), "inner": pa.array([inner], pa.int64())})


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [-1 if before is None else shared(before, first) for before, first in zip(b["before"].to_pylist(), b["first"].to_pylist(), strict=True)]
        yield pa.record_batch([b["pid"], pa.array(found, pa.int64()), b["inner"]], ["pid", "border", "inner"])


class Skeleton:
    """The borders' LCPs and the blocks' minima: two numbers for each block."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        rows = sorted(rows)
        self.at = {pid: i for i, (pid, _, _) in enumerate(rows)}
        self.border = [b for _, b, _ in rows] + [-1]
        self.least = [min(b, inner) for _, b, inner in rows]
        self.before = nearest_smaller([-2, *self.least], [0] * len(rows))[0][1:] - 1 if rows else []

    def block(self, pid: int, table: pa.Table) -> Block:
        i = self.at[pid]
        return Block(table, self.border[i], self.border[i + 1])

    def begin(self, pid: int, depths: np.ndarray) -> np.ndarray:
        """The block where the span of each depth (ascending) that comes into block ``pid`` begins."""
        out, at = np.zeros(len(depths), np.int64), self.at[pid] - 1
        for k in range(len(depths) - 1, -1, -1):
            while self.least[at] >= depths[k]:
                at = int(self.before[at])
            out[k] = at
        return out


def _partials(skeleton: Skeleton):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        pid = key[0].as_py()
        b = skeleton.block(pid, table)
        rows: list[tuple] = []

        def add(first: int, depth: int, n: int, low: int, shared_: int, leaves: int, equal: int, row: int, ends: int) -> None:
            texts = [",".join(map(str, b.ids[i : min(i + CHUNK, row + ends)].tolist())) for i in range(row, row + ends, CHUNK)] or [None]
            rows.append((first, depth, pid, 0, n, low, shared_, leaves, equal, ends, texts[0]))
            rows.extend((first, depth, pid, k, 0, low, 0, 0, 0, 0, t) for k, t in enumerate(texts[1:], 1))

        depth, end, equal = b.left_parts()
        lows = np.minimum.accumulate(b.ids)
        ends = b.ends_at(np.zeros(len(depth), np.int64), depth)
        for f, d, e, q, k in zip(skeleton.begin(pid, depth).tolist(), depth.tolist(), end.tolist(), equal.tolist(), ends.tolist(), strict=True):
            add(f, d, e, int(lows[e - 1]), int(b.sum_shared[e]), int(b.sum_leaf[e]), q, 0, k)
        depth, begin, equal = b.right_parts()
        lows = np.minimum.accumulate(b.ids[::-1])[::-1]
        for d, s, q, k in zip(depth.tolist(), begin.tolist(), equal.tolist(), b.ends_at(begin, depth).tolist(), strict=True):
            add(skeleton.at[pid], d, b.size - s, int(lows[s]), int(b.sum_shared[-1] - b.sum_shared[s + 1]), int(b.sum_leaf[-1] - b.sum_leaf[s]), q, s, k)
        names = [x.split(" ")[0] for x in _PARTS.split(", ")]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.table({k: pa.array(c, pa.string() if k == "ids" else pa.int64()) for k, c in zip(names, cols, strict=True)})

    return work


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the joined ids of each (first, depth), as their pieces stream by in order."""
    now, state, done = None, None, []

    def flush() -> pa.RecordBatch:
        made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["first", "depth", "sha"])
        done.clear()
        return made

    for b in batches:
        for first, depth, ids in zip(b["first"].to_pylist(), b["depth"].to_pylist(), b["ids"].to_pylist(), strict=True):
            if (first, depth) == now:
                state.update(("," + ids).encode())
                continue
            if now:
                done.append((*now, state.hexdigest()))
            now, state = (first, depth), hashlib.sha256(ids.encode())
        if done:
            yield flush()
    if now:
        done.append((*now, state.hexdigest()))
        yield flush()


def _nodes(skeleton: Skeleton):
    def work(_: tuple, table: pa.Table, crossing: pa.Table) -> pa.Table:
        pid = table["pid"][0].as_py()
        b, here = skeleton.block(pid, table), skeleton.at[pid]
        m, lcp, out = b.size, b.lcp, []
        rows = crossing.to_pylist()
        # over the left border, and begun here over the right one: the smallest member by depth
        sides = [{r["depth"]: r["low"] for r in rows if (r["first"] == here) == side} for side in (False, True)]
        values, ids = lcp.tolist(), b.ids.tolist()
        before, low_before, same = nearest_smaller(values, ids)
        after, low_after, _ = (x[::-1] for x in nearest_smaller(values[::-1], ids[::-1]))
        after = np.where(after >= 0, m - after, -1)
        low = np.minimum(low_before, low_after)

        def parents(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            """The smallest member of the node around each span between elements ``left`` and ``right``; -1 << 63: none."""
            out = np.full(len(left), -1 << 63, np.int64)
            for k, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
                at = x if values[x] >= values[y] else y
                depth = values[at]
                if depth < 0:
                    continue
                if at in (0, m):
                    out[k] = sides[at == m and depth > b.least][depth]
                elif before[at] < 0 or after[at] < 0:
                    out[k] = sides[int(before[at] >= 0)][depth]
                else:
                    out[k] = low[at]
            return out

        def expand(row: np.ndarray, top: np.ndarray, bottom: np.ndarray, parent: np.ndarray, own: np.ndarray, n: np.ndarray, children: np.ndarray, leaves: np.ndarray, shared_: np.ndarray) -> None:
            """Nodes of every depth from ``top`` + 1 to ``bottom`` over one span."""
            count = bottom - top
            at = np.repeat(np.arange(len(row)), count)
            depth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + top[at] + 1
            last = depth == bottom[at]
            ends = np.where(last, b.ends_at(row[at], depth), 0)
            sha = [b.ids_hash(r, k) if k else EMPTY for r, k in zip(row[at].tolist(), ends.tolist(), strict=True)]
            out.append((own[at], depth, np.where(depth == top[at] + 1, parent[at], own[at]), n[at], np.where(last, children[at], 1), leaves[at], shared_[at] - (n[at] - 1) * b.words_to(row[at], np.maximum(depth - 1, 0)), sha))

        i = np.arange(m)
        top = np.maximum(lcp[:-1], lcp[1:])
        i = i[top < b.length]
        one = np.ones(len(i), np.int64)
        expand(i, top[i], b.length[i], parents(i, i + 1), b.ids[i], one, one * 0, one, one * 0)
        j = np.arange(m + 1)
        j = j[(same == j) & (before >= 0) & (after >= 0) & (j > 0) & (j < m)]
        p, q = before[j], after[j]
        equal = np.bincount(same[1:m], minlength=m + 1)[j]
        expand(p, np.maximum(lcp[p], lcp[q]), lcp[j], parents(p, q), low[j], q - p, equal + 1 - b.ends_at(p, lcp[j]), b.sum_leaf[q] - b.sum_leaf[p], b.sum_shared[q] - b.sum_shared[p + 1])
        begin = dict(zip(*(x.tolist() for x in b.right_parts()[:2]), strict=True))
        mine = [r for r in rows if r["first"] == here]
        if mine:
            depth = np.array([r["depth"] for r in mine], np.int64)
            row = np.array([begin[r["depth"]] for r in mine], np.int64)
            own, n, equal, ends, leaves, share = (np.array([r[k] for r in mine], np.int64) for k in ("low", "n", "equal", "ends", "leaves", "shared"))
            parent = np.array([sides[d - 1 > b.least][d - 1] if d else -1 << 63 for d in depth.tolist()], np.int64)
            out.append((own, depth, parent, n, equal + 1 - ends, leaves, share - (n - 1) * b.words_to(row, np.maximum(depth - 1, 0)), [r["sha"] or EMPTY for r in mine]))
        names = [x.split(" ")[0] for x in _NODES.split(", ")]
        cols = [np.concatenate([o[k] for o in out]) for k in range(7)]
        arrays = [pa.array(c, pa.int64()) for c in cols]
        arrays[2] = pa.array(cols[2], pa.int64(), mask=cols[1] == 0)
        return pa.table([*arrays, pa.array([s for o in out for s in o[7]], pa.string())], names)

    return work


def trie(sequences: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of :func:`rebuilt` sequences (conv_id, key, words); each conv_id stands once.

    Returns for each distinct sequence of first turns, from the empty one: conv_id (smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (words that members after
    the first of each node below repeat) and ends_sha256 (of the ids, ascending, that end there). Conversations
    without turns are members of the root alone. No rows give no rows. Memory: one block of about ``block``
    turns, and one conversation's key.
    """
    spark = sequences.sparkSession
    store = _store.Store(spark, "prefix-trie")
    made = store.table(sequences.select("conv_id", "key", "words"), "sequences")
    total = made.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    parts = _store.cut(total, block, min(spark.sparkContext.defaultParallelism, _store.cut(total, SMALL)))
    dealt = made.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    dealt = store.table(dealt.withColumns({"pid": F.spark_partition_id().cast("long"), "pos": F.monotonically_increasing_id()}), "blocks")
    measured = store.table(dealt.groupBy("pid").applyInArrow(_measured, "pid long, first binary, last binary, inner long"), "measured")
    edges = measured.withColumn("before", F.lag("last").over(Window.orderBy("pid")))
    skeleton = Skeleton([tuple(r) for r in edges.mapInArrow(_borders, "pid long, border long, inner long").collect()])
    parts_ = store.table(dealt.groupBy("pid").applyInArrow(_partials(skeleton), _PARTS), "parts")
    merged = parts_.groupBy("first", "depth").agg(F.min("low").alias("low"), *[F.sum(c).alias(c) for c in _SUMS])
    hashed = parts_.where("ids IS NOT NULL").repartition("first", "depth").sortWithinPartitions("first", "depth", "pid", "part").select("first", "depth", "ids").mapInArrow(lean(_hashes), "first long, depth long, sha string")
    back = parts_.where("part = 0").select("pid", "first", "depth").join(merged, ["first", "depth"]).join(hashed, ["first", "depth"], "left")
    return dealt.groupBy("pid").cogroup(back.groupBy("pid")).applyInArrow(_nodes(skeleton), _NODES)
