"""Queries over written indexes, tables and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..buckets import BucketTable
from ..operators import angles, postings, sketches
from ..scratch import Steps
from ..sources.tables import spread
from ..sources.tables import table as t
from .catalog import ORACLE, asked, query


def indexed(spark, d, parts=2):
    """The documents' index in the shared folder, in segments, as if they had arrived in parts."""
    folder = f"{Steps(spark, 'index').path}/documents"
    docs = spread(t(spark, d, "documents").select("doc_id", "text"))
    for i in range(parts):
        postings.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == i), folder)
    return folder


@query(ORACLE["bm25_topk"])
def indexed_topk(spark, d):
    """The rows of ``bm25_topk`` from a written index of two segments."""
    found = postings.Search(spark, indexed(spark, d), asked(spark, d).select("query_id", "query"), 12).results
    return found.select("query_id", "doc_id", "n_terms", F.round("score", 4).alias("score"))


@query("""
SELECT vec_id, found, round(c, 9) AS cosine FROM (
  SELECT a.vec_id, b.vec_id AS found, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 12) DESC, found) = 1""")
def near_vectors(spark, d):
    """For every vector the nearest other one of a cosine of 0.3 or more."""
    v = t(spark, d, "embeddings").select("vec_id", "embedding")
    found = angles.nearest_within(v, v, 0.3, "vec_id", "embedding", other=True)
    return found.select(F.col("id").alias("vec_id"), "found", F.round("cosine", 9).alias("cosine"))


@query("""
SELECT o_orderkey, o_orderstatus AS was, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 11 <> 0""")
def bucket_upserts(spark, d):
    """Orders in a table of buckets after an upsert and a removal, beside the version before."""
    orders = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    table = BucketTable.create(orders, f"{Steps(spark, 'buckets').path}/orders", "o_orderkey", 16)
    first = table.version()
    table.upsert(orders.where("o_orderkey % 7 = 0").withColumn("status", F.lit("changed")))
    table.upsert(orders.where("o_orderkey % 11 = 0").select("o_orderkey", F.lit(True).alias("gone")), deleted="gone")
    return table.read().join(table.read(first).select("o_orderkey", F.col("status").alias("was")), "o_orderkey")


@query("""
SELECT event_type, count(value) AS n, count(DISTINCT user_id) > 0 AS users_within, true AS median_within, true AS high_within, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type""")
def event_sketches(spark, d):
    """Statistics of events from sketches kept for each of four parts, and whether they are within their bounds of the exact ones."""
    e = t(spark, d, "events").select("event_type", "user_id", "value")
    parts = [sketches.kept(e.where(F.pmod(F.xxhash64("user_id", "value"), F.lit(4)) == i), "value", "user_id", ["event_type"]) for i in range(4)]
    kept = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    found = sketches.merged(kept, ["event_type"], [0.5, 0.95])
    within = lambda q: F.avg(F.when(F.col("value") < q, 1.0).otherwise(0.0))
    ranks = e.join(F.broadcast(found.select("event_type", "quantiles")), "event_type").groupBy("event_type")
    ranks = ranks.agg(within(F.col("quantiles")[0]).alias("r0"), within(F.col("quantiles")[1]).alias("r1"), F.countDistinct("user_id").alias("users"))
    near = lambda c, x: F.abs(F.col(c) - x) <= sketches.RANK_ERROR
    users = F.abs(F.col("n_distinct") - F.col("users")) <= sketches.DISTINCT_ERROR * F.col("users")
    shown = [users.alias("users_within"), near("r0", 0.5).alias("median_within"), near("r1", 0.95).alias("high_within")]
    return found.join(ranks, "event_type").select("event_type", "n", *shown, F.round("mean", 4).alias("mean"), "least", "most")
