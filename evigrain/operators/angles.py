"""The nearest vector of at least a given cosine, without comparing every pair.

Pivots (a bounded sample of the right side) cut it into cells: each right vector belongs to its nearest pivot. Angles obey
the triangle inequality, so a left vector within the angle t of a right one lies within t of its cell's ring of angles,
and its angle to that pivot is at most 2 t more than to its own nearest pivot. A left vector meets in every cell that
these bounds leave the right vectors of nearly its angle: no pair is lost. Cells are packed into groups of some thousand rows,
and a left vector goes once to each group where it has a cell, so that it is copied by the size of the table in groups even
where the bounds leave all cells. Large cells are dealt in blocks. Cosines are matrix products in single
precision; those that may be a row's highest are computed again in double precision, in a fixed order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Steps
from ..sources.tables import spread

PIVOTS = 1024
#: Rows that pivots are chosen from, for each pivot.
SAMPLE = 8
#: Rows of a group that one task compares with as many of the other side, and components of these at most.
ROWS = 32768
COMPONENTS = 1 << 21
CHUNK = 256
#: Share of pairs that the bounds leave above which a block is compared whole, and its right rows in one product.
DENSE, DEEP = 0.5, 2048
#: Pairs whose cosines are computed again at once.
AGAIN = 65536
#: More than the error of an angle from a cosine in double precision.
SLACK = 1e-6


def usable(df: DataFrame, key: str, vec: str) -> DataFrame:
    """id and v (doubles): rows with an id and a vector of finite components that aren't all zero."""
    v = df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _spread(x: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each the farthest from those before it, so that every cluster of the sample has one."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(count, len(x)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-12:
            break
        chosen.append(far)
        near = np.maximum(near, x @ x[far])
    return x[chosen]


def _open(a: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, reach: float) -> np.ndarray:
    """Whether cells may hold a vector within ``reach`` of rows at the angles ``a`` to the cells' pivots."""
    return (a <= high + reach) & (a >= low - reach) & (a <= near + 2 * reach)


def _rows(ids: pa.Array, cells: np.ndarray, angles: np.ndarray, vectors: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([ids, pa.array(cells.astype(np.int32)), pa.array(angles), vectors], ["id", "cell", "angle", "v"])


def nearest_within(left: DataFrame, right: DataFrame, least: float, key: str = "id", vec: str = "v", other: bool = False, pivots: int | None = None) -> DataFrame:
    """For each left row the right one of the highest cosine, if it is at least ``least``: id, found, cosine, compared.

    Both sides: ``key`` (whole numbers) and ``vec``; ``other`` leaves out right rows of the same key. Ties go to the smaller key;
    repeated keys count as one row each on the right, and as one row on the left (its best). Null, zero and non-finite vectors take no part, nor do those of another length than
    the right side's commonest (ties to the smaller). ``compared`` counts the pairs that were multiplied for the row.
    Driver: ``SAMPLE`` times ``pivots`` vectors (by default four times the root of the right side's number, at most ``PIVOTS``), and a few numbers for each pivot.
    """
    spark = left.sparkSession
    steps = Steps(spark, "angles")
    r = usable(right, key, vec)
    sizes = r.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    shape = "id long, found long, cosine double, compared long"
    if not sizes:
        return spark.createDataFrame([], shape)
    r = spread(r.where(F.size("v") == sizes["size"]))
    count = pivots or min(PIVOTS, 4 * math.isqrt(sizes["count"]) + 1)
    sample = r.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * count).collect()
    centres = _spread(_unit(pa.array([x.v for x in sample], pa.list_(pa.float64()))), count)
    reach = math.acos(max(-1.0, min(1.0, least))) + SLACK
    kind = "id long, cell int, angle double, v array<double>"

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                a = _angles(_unit(b.column(1)), centres)
                cell = a.argmin(1)
                yield _rows(b.column(0), cell, a[np.arange(len(a)), cell], b.column(1))

    homes = steps.write(r.mapInArrow(home, kind), "homes")
    rings = homes.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).collect()
    low, high, held = np.full(len(centres), np.inf), np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
    for x in rings:
        low[x.cell], high[x.cell], held[x.cell] = x.low, x.high, x.n
    asked = spread(usable(left, key, vec).where(F.size("v") == sizes["size"]))
    # blocks are small enough for every core to have some
    each = -(-max(sizes["count"], asked.count()) // math.isqrt(4 * spark.sparkContext.defaultParallelism))
    most = max(1, min(ROWS, COMPONENTS // sizes["size"], max(each, ROWS // 16)))
    group, full = np.zeros(len(centres), np.int64), 0
    for c in range(1, len(centres)):
        full += held[c - 1]
        group[c] = group[c - 1] + int(full + held[c] > most)
        full = full if group[c] == group[c - 1] else 0
    firsts = np.flatnonzero(np.diff(group, prepend=-1))

    def meets(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows by groups: whether a row has a cell there; and each row's angle to its nearest pivot."""
        a = _angles(_unit(v), centres)
        near = a.min(1)
        return np.logical_or.reduceat(_open(a, low, high, near[:, None], reach), firsts, axis=1), near

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(firsts), np.int64)
        for b in batches:
            for lo in range(0, len(b), CHUNK):
                n += meets(b.column(1).slice(lo, CHUNK))[0].sum(0)
        yield pa.record_batch([pa.array(np.arange(len(n)), pa.int32()), pa.array(n)], ["group", "n"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), CHUNK):
                part = b.slice(lo, CHUNK)
                there, near = meets(part.column(1))
                row, to = np.nonzero(there)
                at = pa.array(row)
                yield _rows(part.column(0).take(at), to, near[row], part.column(1).take(at))

    rows = {x["group"]: x["n"] for x in asked.mapInArrow(tally, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect() if x["n"]}
    cut = lambda n: int(-(-n // most))
    # a row for each group, and for each cell
    sums = np.add.reduceat(held, firsts)
    blocks = spark.createDataFrame([(g, cut(n), cut(sums[g])) for g, n in rows.items() if sums[g]], "group int, ls int, rs int")
    cells = F.broadcast(blocks.join(spark.createDataFrame([(c, int(g)) for c, g in enumerate(group)], "cell int, group int"), "group"))
    place = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = asked.mapInArrow(send, kind).withColumnRenamed("cell", "group").join(F.broadcast(blocks), "group").select("id", "angle", "v", "group", place("ls").alias("lb"), every("rs").alias("rb"))
    two = homes.join(cells, "cell").select("id", "cell", "angle", "v", "group", every("ls").alias("lb"), place("rs").alias("rb"))
    # more than twice the error of a product of unit vectors in single precision
    slack = 4 * (sizes["size"] + 8) * float(np.finfo(np.float32).eps)

    def compare(_: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        if len(x) and len(y):
            y = y.sort_by([("cell", "ascending"), ("angle", "ascending"), ("id", "ascending")])
            xs, ys, near, ya, xi, yi, cell = _unit(x["v"]), _unit(y["v"]), x["angle"].to_numpy(), y["angle"].to_numpy(), x["id"].to_numpy(), y["id"].to_numpy(), y["cell"].to_numpy()
            best, score, work = np.full(len(xi), np.iinfo(np.int64).max), np.full(len(xi), -np.inf), np.zeros(len(xi), np.int64)
            xf, yf, own = xs.astype(np.float32), ys.astype(np.float32), np.isin(xi, yi) & other
            edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
            some = slice(None, None, -(-len(xi) // CHUNK))
            left_open = _open(_angles(xs[some], centres[cell[edges[:-1]]]), low[cell[edges[:-1]]], high[cell[edges[:-1]]], near[some, None], reach)
            # where the bounds leave most pairs, large products beat the rest of them
            every = (left_open * np.diff(edges)).sum() > DENSE * len(left_open) * len(yi)
            edges = [*range(0, len(yi), DEEP), len(yi)] if every else edges.tolist()
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                c = cell[i]
                met, xa = np.arange(len(xi)), None
                if not every:
                    xa = _angles(xs, centres[c : c + 1])[:, 0]
                    met = np.flatnonzero(_open(xa, low[c], high[c], near, reach))
                    met = met[np.argsort(xa[met], kind="stable")]
                for lo in range(0, len(met), CHUNK):
                    part = met[lo : lo + CHUNK]
                    a, z = (i, j) if every else i + np.searchsorted(ya[i:j], (xa[part[0]] - reach, xa[part[-1]] + reach), "right")
                    work[part] += z - a
                    if z == a:
                        continue
                    dots = xf[part] @ yf[a:z].T
                    if (same := np.flatnonzero(own[part])).size:
                        at = xi[part[same]][:, None] == yi[a:z]
                        dots[same] = np.where(at, -np.inf, dots[same])
                    # products differ with a row's place in the matrix: sums of rows don't, so equal vectors have equal cosines
                    row, col = np.nonzero(dots >= (np.maximum(np.maximum(dots.max(1), score[part]), least) - slack)[:, None].astype(np.float32))
                    for k in range(0, len(row), AGAIN):
                        r, f = part[row[k : k + AGAIN]], a + col[k : k + AGAIN]
                        exact = (ys[f] * xs[r]).sum(1)
                        order = np.lexsort((yi[f], -exact, r))
                        order = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
                        r, f, exact = r[order], yi[f[order]], exact[order]
                        won = (exact > score[r]) | ((exact == score[r]) & (f < best[r]))
                        best[r[won]], score[r[won]] = f[won], exact[won]
            keep = score >= least
            out = [xi, np.where(keep, best, 0), np.where(keep, score, -2.0), work]
        return pa.table(dict(zip(("id", "found", "cosine", "compared"), map(pa.array, out), strict=True)))

    met = one.groupBy("group", "lb", "rb").cogroup(two.groupBy("group", "lb", "rb")).applyInArrow(compare, shape)
    best = met.groupBy("id").agg(F.min_by("found", F.struct(-F.col("cosine"), "found")).alias("found"), F.max("cosine").alias("cosine"), F.sum("compared").alias("compared"))
    return best.where(F.col("cosine") >= least)
