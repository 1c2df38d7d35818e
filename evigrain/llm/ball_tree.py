"""Exact top-k by integer inner product with ball trees.

Vectors become whole numbers, are dealt to shards by hash, and each shard gets a ball tree, written to the
shared folder. A task takes a block of queries through the shards, the most promising first. A ball's upper
bound on the inner product is its centre times the query plus its radius times the query's norm. From the
root a heap opens balls by the highest bound any query of the block has there; a query leaves a branch where
the bound falls below its current k-th score, which it brings along from shard to shard, and a branch that no
query is left in is cut with all that is below it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _vectors

SCALE = 256
SHARD_ROWS = 16_384
LEAF_ROWS = 128


def build(x: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """A ball tree: rows in leaf order, and for each node its ball, its rows and its second child.

    Nodes are in preorder, so a node's first child comes right after it; the second is -1 for a leaf. A ball
    splits at the median along the line through two of its far points.
    """
    order, nodes, todo, second = np.arange(len(ids)), [], [(0, len(ids), -1)], []
    while todo:
        lo, hi, parent = todo.pop()
        rows = order[lo:hi]
        points = x[rows].astype(float)
        centre = points.mean(0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(1)).max())
        leaf = hi - lo <= LEAF_ROWS or radius == 0
        me = len(nodes)
        nodes.append((lo, hi, radius, centre))
        second.append(-1)
        if parent >= 0:
            second[parent] = me
        if not leaf:
            one = points[int(((points - centre) ** 2).sum(1).argmax())]
            two = points[int(((points - one) ** 2).sum(1).argmax())]
            mid = (hi - lo) // 2
            order[lo:hi] = rows[np.argpartition(points @ (two - one), mid)]
            todo += [(lo + mid, hi, me), (lo, lo + mid, -1)]
    lo, hi, radius, centre = zip(*nodes, strict=True)
    small = np.abs(x).max(initial=0) < 1 << 31
    return {
        "id": ids[order], "point": x[order].astype(np.int32 if small else np.int64).ravel(), "lo": np.array(lo), "hi": np.array(hi), "second": np.array(second),
        "radius": np.array(radius), "centre": np.concatenate(centre),
    }


class Tree:
    """A reader of one shard."""

    def __init__(self, path: str, size: int):
        self.a, self.size = _store.open_arrays(path), size
        self.centre = self.a["centre"].reshape(-1, size)
        self.second = self.a["second"]

    def bound(self, node: int, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Each query's upper bound in a ball; slightly raised against rounding."""
        return _raised(q @ self.centre[node] + norm * self.a["radius"][node])

    def rows(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = int(self.a["lo"][node]), int(self.a["hi"][node])
        return self.a["id"][lo:hi], self.a["point"][lo * self.size : hi * self.size].reshape(-1, self.size)


def _raised(b: np.ndarray) -> np.ndarray:
    return b + 1e-9 * np.abs(b) + 1e-6


def _whole(x: np.ndarray) -> np.ndarray:
    x = np.floor(SCALE * x)
    if np.abs(x).max(initial=0) >= 2**62:
        raise OverflowError("components beyond 64 bits")
    return x.astype(np.int64)


def _products(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products; an error where one might not fit 64 bits."""
    most = float(np.abs(points).max(initial=0)) * float(np.abs(q).max(initial=0)) * q.shape[1]
    if most < 2**52:
        return (q.astype(float) @ points.T.astype(float)).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("inner products beyond 64 bits")
    return q @ points.T.astype(np.int64)


def search_shards(queries: np.ndarray, q: np.ndarray, files: list[tuple[str, np.ndarray, float]], k: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """Takes a block of queries through all shards (file, centre and radius of each); exact for whole numbers.

    Returns the results, and with how many rows queries were multiplied.
    """
    real = q.astype(float)
    norm = np.sqrt((real**2).sum(1))
    whole = np.stack([_raised(real @ c + norm * r) for _, c, r in files], axis=1)
    top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    kth = np.full(len(q), -np.inf)
    work = 0
    for s in np.argsort(-whole.max(0)).tolist():
        open_ = np.flatnonzero(whole[:, s] >= kth)
        if not len(open_):
            continue
        tree = Tree(files[s][0], q.shape[1])
        heap = [(-float(whole[open_, s].max()), 0, open_, whole[open_, s])]
        while heap:
            _, node, rows, bound = heapq.heappop(heap)
            rows, bound = rows[bound >= kth[rows]], bound[bound >= kth[rows]]
            if not len(rows):
                continue
            if tree.second[node] >= 0:
                for child in (node + 1, int(tree.second[node])):
                    own = np.minimum(bound, tree.bound(child, real[rows], norm[rows]))
                    if len(near := np.flatnonzero(own >= kth[rows])):
                        heapq.heappush(heap, (-float(own[near].max()), child, rows[near], own[near]))
                continue
            ids, points = tree.rows(node)
            new = _products(q[rows], points)
            work += new.size
            for r in np.flatnonzero(new.max(1) >= kth[rows]).tolist():
                row = int(rows[r])
                good = (new[r] >= kth[row]) & (ids != queries[row])
                if good.any():
                    found, scores = np.concatenate([top[row][0], ids[good]]), np.concatenate([top[row][1], new[r][good]])
                    keep = _vectors.best(found, scores, k)
                    top[row] = found[keep], scores[keep]
                    if len(keep) == k:
                        kth[row] = scores[keep[-1]]
    return [(int(i), *t) for i, t in zip(queries, top, strict=True)], work


def top_k(table: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """For each row whose ``vec_id`` is divisible by ``every``, the ``k`` highest inner products of all rows.

    Components become floor(256 * x). Returns query_id, rank, vec_id, score (long), ties to the smaller id.
    Candidates are the rows with another ``vec_id`` than the query's; a repeated row is found repeatedly.
    Which rows take part: see ``_vectors.usable``; other columns are left out; no rows give no rows.
    Scores that might not fit 64 bits are an error. Memory: one shard and one block of queries in a task, one small
    row a shard on the driver.
    """
    spark = table.sparkSession
    store = _store.Store(spark, "ball-tree")
    v = store.table(_vectors.usable(table, nonzero=False), "vectors")
    n = v.count()
    shape = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], shape)
    folder, shards = store.uri, _store.cut(n, SHARD_ROWS)

    def grow(key: tuple, rows: pa.Table) -> pa.Table:
        x = _whole(_vectors.matrix(rows["embedding"]))
        tree = build(x, rows["vec_id"].to_numpy())
        d = x.shape[1]
        path = _store.write_arrays(f"{folder}/trees", f"s{key[0].as_py()}", tree)
        return pa.table({"path": [path], "centre": pa.array([tree["centre"][:d].tolist()], pa.list_(pa.float64())), "radius": [float(tree["radius"][0])]})

    made = v.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).groupBy("shard").applyInArrow(grow, "path string, centre array<double>, radius double")
    files = [(r.path, np.array(r.centre), r.radius) for r in sorted(store.table(made, "trees-made").collect(), key=lambda r: r.path)]

    store.keep_only("vectors", "trees")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), _vectors.QUERY_ROWS):
                part = b.slice(lo, _vectors.QUERY_ROWS)
                q = _whole(_vectors.matrix(part.column(1)))
                yield _vectors.results(search_shards(part.column(0).to_numpy(), q, files, k)[0], pa.int64())

    queries, _ = _vectors.query_rows(v, every)
    return queries.mapInArrow(search, shape)
