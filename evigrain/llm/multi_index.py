"""Approximate nearest neighbours with an inverted multi-index.

Each half of a (normalised) vector has its own centroids, fitted on a bounded sample; a pair of centroids
is a cell. Every row goes to its cell's list; lists are files in the shared folder, one for each centroid
of the first half (several where it is crowded), sorted by the second half's centroid. A query walks the
centroid pairs by summed distance with a heap until their lists hold enough rows. The first of them are
reranked at once; how far the k-th row found is, and each cell's radius, then tell which of the other cells
can matter at all, and where to stop. Those are read list by list for a block of queries together: products
of matrices find the candidates, and the exact measure decides among them.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _vectors

SAMPLE = 20_000
CELL_ROWS = 8
MOST_CENTROIDS = 1024
FILE_ROWS = 100_000
FIRST_ROWS = 256
BATCH_ROWS = 8192
RECALL = 0.97
CALIBRATION = 100


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's algorithm; an empty centroid moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    kinds = np.unique(x, axis=0)
    k = min(k, len(kinds))
    c = kinds[rng.choice(len(kinds), k, replace=False)]
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        near = d.argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if (n == 0).any():
            far = np.argsort(-d[np.arange(len(x)), near])[: int((n == 0).sum())]
            c[np.flatnonzero(n == 0)[: len(far)]] = x[far]
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def walk(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Sums and pairs (i, j) by ascending ``one[i] + two[j]``, with a heap over the two sorted lists."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    x, y = one[a].tolist(), two[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap, at = [(x[0] + y[0], 0, 0)], [-1] * len(a)
    while heap:
        total, i, j = heapq.heappop(heap)
        yield total, a[i], b[j]
        at[i] = j
        if j + 1 < len(b) and (i == 0 or at[i - 1] > j):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if i + 1 < len(a) and at[i + 1] == j - 1:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))


def calibrate(x: np.ndarray, first: np.ndarray, second: np.ndarray, k: int, recall: float) -> float:
    """The share of rows to rerank so that ``recall`` of the true ``k`` nearest are among them.

    Measured by brute force within the sample: every true neighbour's rank in the order of the walk. On
    clustered vectors the share is small, on vectors without structure it is large.
    """
    half, n = first.shape[1], len(x)
    if n <= 2 * k:
        return 1.0
    rows = np.linspace(0, n - 1, min(CALIBRATION, n)).astype(int)
    i, j = _near(x[:, :half], first), _near(x[:, half:], second)
    ranks = []
    for r in rows.tolist():
        s = x @ x[r]
        s[r] = -np.inf
        d = ((first - x[r, :half]) ** 2).sum(1)[i] + ((second - x[r, half:]) ** 2).sum(1)[j]
        ranks.append((d[:, None] <= d[np.argpartition(-s, k)[:k]]).sum(0) / n)
    return float(np.quantile(np.concatenate(ranks), recall))


def nearest(table: DataFrame, k: int = 5, every: int = 50, recall: float = RECALL, share: float | None = None) -> DataFrame:
    """The ``k`` rows found nearest by cosine for each row whose ``vec_id`` is divisible by ``every``.

    Returns query_id, rank, vec_id, score (the cosine of the original vectors, in double precision) and
    reranked (how many rows the query was compared with), ties to the smaller id. Candidates are the rows with another ``vec_id`` than the query's; a repeated row is
    found repeatedly. A query walks over ``share`` of all rows, or the share that reaches ``recall`` on the
    sample (see :func:`calibrate`), and over ``k`` others at least; it reads less where bounds allow. Which
    rows take part: see ``_vectors.usable``; other columns are left out; no rows give no rows. Centroids
    and share are fitted on at most ``SAMPLE`` rows, those of the smallest hashes; every row is indexed.
    Memory: the centroids and the cells' sizes and radii (at most ``MOST_CENTROIDS`` squared numbers) on the
    driver; lists are mapped, and a block of queries meets ``BATCH_ROWS`` rows at a time.
    """
    spark = table.sparkSession
    store = _store.Store(spark, "multi-index")
    v = store.table(_vectors.usable(table, nonzero=True), "vectors")
    n = v.count()
    shape = "query_id long, rank int, vec_id long, score double, reranked long"
    if not n:
        return spark.createDataFrame([], shape)
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()  # bounded
    x = _unit(_vectors.matrix(sample["embedding"]))
    half = max(1, x.shape[1] // 2)
    size = int(min(max((n / CELL_ROWS) ** 0.5, 2), MOST_CENTROIDS))
    first, second = kmeans(x[:, :half], size), kmeans(x[:, half:], size, seed=4) if x.shape[1] > 1 else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _unit(_vectors.matrix(b.column(1)))
            i, j = (_near(u[:, :half], first), _near(u[:, half:], second)) if len(b) else (np.zeros(0, int),) * 2
            away = np.sqrt(((u - np.concatenate([first[i], second[j]], axis=1)) ** 2).sum(1)) if len(b) else np.zeros(0)
            yield pa.record_batch([*b.columns, pa.array(i), pa.array(j), pa.array(away)], ["vec_id", "embedding", "i", "j", "away"])

    placed = store.table(v.mapInArrow(assign, "vec_id long, embedding array<double>, i long, j long, away double"), "placed")
    counts, radius = np.zeros((len(first), len(second)), np.int64), np.zeros((len(first), len(second)))
    cells = placed.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("away").alias("away")).toArrow()  # at most MOST_CENTROIDS squared
    at = cells["i"].to_numpy(), cells["j"].to_numpy()
    counts[at], radius[at] = cells["n"].to_numpy(), cells["away"].to_numpy()
    parts = np.maximum(1, -(-counts.sum(1) // FILE_ROWS)).tolist()
    folder = store.uri

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        j, ids, e = rows["j"].to_numpy(), rows["vec_id"].to_numpy(), _vectors.matrix(rows["embedding"])
        order = np.lexsort((ids, j))
        start = np.searchsorted(j[order], np.arange(len(second) + 1))
        path = _store.write_arrays(f"{folder}/lists", f"i{key[0].as_py()}", {"start": start, "id": ids[order], "vector": e[order].ravel()})
        return pa.table({"i": [key[0].as_py()], "path": [path]})

    split = F.pmod(F.xxhash64("vec_id"), F.element_at(F.array(*[F.lit(p) for p in parts]), (F.col("i") + 1).cast("int")))
    made = placed.withColumn("part", split).groupBy("i", "part").applyInArrow(write, "i long, path string")
    files: list[list[str]] = [[] for _ in first]
    for r in store.table(made, "files").collect():
        files[r.i].append(r.path)
    files = [sorted(f) for f in files]
    share = calibrate(x, first, second, k, recall) if share is None else share
    want = max(int(np.ceil(share * n)), k) + 1
    index = Index(first, second, counts, radius, files, want, k)
    store.keep_only("vectors", "lists")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _vectors.matrix(b.column(1))
            u = _unit(q) if len(b) else q
            found = []
            for lo in range(0, len(b), _vectors.QUERY_ROWS):
                part = slice(lo, lo + _vectors.QUERY_ROWS)
                found += index.search(b.column(0).to_numpy()[part], q[part], u[part])
            out = _vectors.results([f[:3] for f in found], pa.float64())
            yield out.append_column("reranked", pa.array(np.repeat([f[3] for f in found], [len(f[1]) for f in found]).astype(np.int64)))

    queries, _ = _vectors.query_rows(v, every)
    return queries.mapInArrow(search, shape)


class Index:
    """Centroids, cells and lists, as a task uses them."""

    def __init__(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray, radius: np.ndarray, files: list[list[str]], want: int, k: int):
        self.first, self.second, self.counts, self.radius = first, second, counts, radius
        self.files, self.want, self.k = files, want, k
        self.widest = float(radius.max(initial=0))

    def search(self, queries: np.ndarray, q: np.ndarray, u: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
        """For a block of queries, ``u`` their unit vectors: ids and scores found, and how many rows each was compared with."""
        half = self.first.shape[1]
        top = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        work, rest = np.zeros(len(q), np.int64), defaultdict(list)
        for r in range(len(q)):
            cells = walk(((self.first - u[r, :half]) ** 2).sum(1), ((self.second - u[r, half:]) ** 2).sum(1))
            top[r], work[r], reach, passed = self._first(int(queries[r]), q[r], cells)
            for d, i, j in cells if passed < self.want else ():
                away = max(d, 0.0) ** 0.5 - 1e-9
                if away - self.widest > reach:
                    break
                n = int(self.counts[i, j])
                passed += n
                if n and away - self.radius[i, j] <= reach:
                    rest[i].append((r, j))
                    work[r] += n
                if passed >= self.want:
                    break
        for i in sorted(rest):
            wanted = np.zeros((len(q), len(self.second)), bool)
            wanted[tuple(np.array(rest.pop(i)).T)] = True
            for path in self.files[i]:
                self._block(queries, q, u, wanted, _store.open_arrays(path), top)
        return [(int(x), *t, int(w)) for x, t, w in zip(queries, top, work, strict=True)]

    def _first(self, query: int, q: np.ndarray, cells: Iterator[tuple[float, int, int]]) -> tuple[tuple[np.ndarray, np.ndarray], int, float, int]:
        """Reranks the nearest cells: what was found, rows compared, how far the k-th is, rows walked over."""
        lists: dict[int, list[int]] = {}
        held = 0
        for _, i, j in cells:
            if n := int(self.counts[i, j]):
                lists.setdefault(i, []).append(j)
                held += n
            if held >= min(self.want, FIRST_ROWS):
                break
        found = np.zeros(0, np.int64), np.zeros(0)
        for i, js in lists.items():
            for path in self.files[i]:
                a = _store.open_arrays(path)
                lo, hi = a["start"][js], a["start"][1:][js]
                size = hi - lo
                found = self._add(found, query, q, a, np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum()))
        full = len(found[0]) == self.k
        return found, held, float(np.sqrt(max(2 - 2 * found[1][-1], 0))) + 1e-7 if full else np.inf, held

    def _add(self, found: tuple[np.ndarray, np.ndarray], query: int, q: np.ndarray, a: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best of those found and these rows of a list, by the exact measure."""
        rows = rows[a["id"][rows] != query]
        x = a["vector"].reshape(-1, len(q))[rows]
        # row sums don't depend on a row's place, so equal vectors have equal scores
        own = (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))
        ids, scores = np.concatenate([found[0], a["id"][rows]]), np.concatenate([found[1], own])
        top = _vectors.best(ids, scores, self.k)
        return ids[top], scores[top]

    def _block(self, queries: np.ndarray, q: np.ndarray, u: np.ndarray, wanted: np.ndarray, a: dict[str, np.ndarray], top: list) -> None:
        """One list for a block of queries that want some of its cells (``wanted``: query, second centroid)."""
        asked = np.flatnonzero(wanted.any(1))
        cell = np.repeat(np.arange(len(self.second)), np.diff(a["start"]))
        vectors = a["vector"].reshape(-1, q.shape[1])
        use = np.flatnonzero(wanted.any(0)[cell])
        for lo in range(0, len(use), BATCH_ROWS):
            rows = use[lo : lo + BATCH_ROWS]
            near = u[asked] @ _unit(vectors[rows]).T
            least = np.array([top[r][1][-1] if len(top[r][1]) == self.k else -2.0 for r in asked]) - 1e-9
            hit = (near >= least[:, None]) & wanted[np.ix_(asked, cell[rows])]
            for n in np.flatnonzero(hit.any(1)).tolist():
                r, some = int(asked[n]), np.flatnonzero(hit[n])
                if len(some) > 4 * self.k:  # far fewer than these can be among the best
                    floor = np.partition(near[n, some], len(some) - self.k - 1)[len(some) - self.k - 1]
                    some = some[near[n, some] >= floor - 1e-9]
                top[r] = self._add(top[r], int(queries[r]), q[r], a, rows[some])
