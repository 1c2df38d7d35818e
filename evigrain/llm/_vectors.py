"""Vector columns for the two search operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_ROWS = 256


def usable(table: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part.

    Left out are null ids and vectors that are null, empty, or hold null or non-finite components; with ``nonzero``
    also vectors of zeros. Vectors of unequal lengths have no product: those of the commonest length (of equally
    common ones the smaller) take part.
    """
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    if nonzero:
        v = v.where(F.exists("embedding", lambda x: x != 0))
    sizes = v.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return v.where(F.size("embedding") == (sizes["size"] if sizes else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id, best first."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= floor)
        return rows[np.lexsort((ids[rows], -scores[rows]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def results(rows: list[tuple[int, np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.RecordBatch:
    """Query id, found ids and scores, as rows of the result."""
    n = [len(ids) for _, ids, _ in rows]
    cat = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
    return pa.record_batch(
        [
            pa.array(np.repeat(np.array([q for q, _, _ in rows], np.int64), n) if rows else np.zeros(0, np.int64)),
            pa.array(cat([np.arange(1, m + 1, dtype=np.int32) for m in n], np.int32)),
            pa.array(cat([ids for _, ids, _ in rows], np.int64), pa.int64()),
            pa.array(cat([s for _, _, s in rows], kind.to_pandas_dtype()), kind),
        ],
        ["query_id", "rank", "vec_id", "score"],
    )


def query_rows(v: DataFrame, every: int) -> tuple[DataFrame, int]:
    """The queries, dealt in parts of some hundreds."""
    q = v.where(F.pmod("vec_id", F.lit(every)) == 0)
    n = q.count()
    return q.repartition(max(1, -(-n // QUERY_ROWS)), "vec_id"), n
