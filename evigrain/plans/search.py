"""The search plan: lexical, vector and concept candidates, gate, fusion, citations, evidence packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranking
from ..operators.ranking import Gate

LEXICAL, VECTOR, CONCEPT, NAMED = 25, 25, 10, 2


def candidates(docs: DataFrame, vectors: DataFrame, queries: DataFrame, named: DataFrame | None = None, facts: DataFrame | None = None, group: str = "doc_id") -> DataFrame:
    """Candidates of up to five branches.

    ``docs``: doc_id, text; ``vectors``: vec_id (a doc_id), embedding, label; ``queries``: query_id, query,
    query_vec, label. Filters belong on ``docs`` and ``vectors`` before: then they hold in every branch.
    ``named`` (query_id, ``group``) adds the ``NAMED`` best rows of documents that a query names; ``facts``
    (query_id, doc_id) what assertions rest on.
    """
    scored = ranking.bm25(docs, queries).withColumn("score", F.round("score", 6))
    lex = ranking.top(scored, LEXICAL, [F.desc("score"), F.asc("doc_id")], ["query_id"]).select("query_id", F.col("doc_id").alias("chunk_id"), F.col("score").alias("lex"))
    near = ranking.cosine_topk(vectors, queries, VECTOR).select("query_id", F.col("vec_id").alias("chunk_id"), F.round("cosine", 6).alias("cos"))
    labelled = queries.where("label is not null")
    same = vectors.select("vec_id", "embedding", "label").join(ranking.small(labelled.select("query_id", "query_vec", "label")), "label")
    same = same.withColumn("cosine", ranking.dot(F.col("embedding"), F.col("query_vec")) / (ranking.norm(F.col("embedding")) * ranking.norm(F.col("query_vec"))))
    concept = ranking.top(same, CONCEPT, [F.desc("cosine"), F.asc("vec_id")], ["query_id"]).select("query_id", F.col("vec_id").alias("chunk_id"), F.round("cosine", 6).alias("cos"))
    sources = {"lexical": lex, "vector": near, "concept": concept}
    if named is not None:
        own = docs.select(F.col("doc_id").alias("chunk_id"), F.col(group).alias("_g")).join(ranking.small(named.select("query_id", F.col(group).alias("_g"))), "_g")
        own = own.join(scored.select("query_id", F.col("doc_id").alias("chunk_id"), "score"), ["query_id", "chunk_id"], "left")
        own = ranking.top(own, NAMED, [F.desc(F.coalesce("score", F.lit(0.0))), F.asc("chunk_id")], ["query_id", "_g"])
        sources["name"] = own.select("query_id", "chunk_id", F.col("score").alias("lex"))
    if facts is not None:
        sources["fact"] = facts.select("query_id", F.col("doc_id").alias("chunk_id")).distinct()
    return ranking.union_candidates(**sources)


def evidence(docs: DataFrame, vectors: DataFrame, queries: DataFrame, gate: Gate, group: str = "source", named: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Candidates with signals; those kept are fused and placed. ``group``: the column of ``docs`` to diversify by."""
    found = candidates(docs, vectors, queries, named, facts, group).drop("doc_id")
    found = found.join(docs.select(F.col("doc_id").alias("chunk_id"), F.col(group).alias("doc_id")), "chunk_id")
    return ranking.signals(found, gate)


def ranked(signalled: DataFrame) -> DataFrame:
    return ranking.fuse(signalled.where("kept"))


def cited(signalled: DataFrame, named: Column, anew: bool = True) -> DataFrame:
    """At most six citations a query, one for each document, named documents promoted.

    Without ``anew`` the six places are those of all chunks, so further chunks of a document take up places.
    """
    return ranking.promote(ranking.best_per_document(ranked(signalled), anew), named)


def branches(signalled: DataFrame) -> DataFrame:
    """For each query and signal: candidates that have it, those kept, and the best place among the kept."""
    long = signalled.select("query_id", "chunk_id", "kept", F.explode(F.create_map(*[x for c in ("lexical", "semantic", "by_concept") for x in (F.lit(c), F.col(c))])).alias("branch", "on"))
    return long.groupBy("query_id", "branch").agg(F.count_if("on").alias("hits"), F.count_if(F.col("on") & F.col("kept")).alias("survivors"))


def packet(chosen: DataFrame) -> DataFrame:
    """The evidence of each query as markdown: a numbered line for each citation."""
    line = F.format_string("[%d] %s (%s)", "citation", "quote", "doc_id")
    lines = F.array_sort(F.collect_list(F.struct("citation", line.alias("line"))))
    return chosen.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("markdown"), F.count("*").alias("n"))
