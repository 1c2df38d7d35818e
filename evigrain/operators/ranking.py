"""Retrieval: BM25, names, cosine, candidate union, gate, fusion, diversification, excerpts.

All operators take a batch of queries at once. Query terms and query vectors are small tables whose sizes
are checked before they are broadcast; document sides are never broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planning import UNITS as QUERY_UNITS
from ..functions.text import same_word, stemmed, words
from ..functions.vectors import dot, norm
from ..scratch import Steps

#: Rows of a query side up to which it is broadcast.
BROADCAST_ROWS = 100_000
#: Query terms up to which the scan itself looks for them.
LISTED_TERMS = 1000


@dataclass(frozen=True)
class Gate:
    """Thresholds of an embedding space (fixed values): concept, strong, semantic."""

    semantic: float = 0.42
    strong: float = 0.55
    concept: float = 0.38
    lexical_share: float = 0.12
    named: float = 10.0


GATES = {"yandex-256": Gate(0.58, 0.66, 0.50), "qwen3-0.6b": Gate(0.42, 0.55, 0.38)}
RRF_K = 60
CITATIONS = 6
QUOTE = 400
_NUMBER = re.compile(r"\d+(?:[.,]\d+)?", re.A)
#: A number with a unit, as queries have them.
PHRASE = rf"\d+(?:[.,]\d+)?\s*(?:{QUERY_UNITS})"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else the planner chooses."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def each_with(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Each row with each row of ``few``, which is broadcast in blocks of checked size (dealt by hash of ``key``)."""
    blocks = -(-few.count() // BROADCAST_ROWS)
    if blocks <= 1:
        return rows.crossJoin(F.broadcast(few))
    place = F.pmod(F.xxhash64(key), F.lit(blocks))
    parts = [rows.crossJoin(F.broadcast(few.where(place == i))) for i in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def query_terms(queries: DataFrame, analyse: Callable[[Column], Column] = words) -> DataFrame:
    """Distinct terms of queries (query_id, query)."""
    return queries.select("query_id", F.explode(F.array_distinct(analyse(F.col("query")))).alias("term"))


def postings(docs: DataFrame, text: str, key: str, terms: DataFrame | None = None, analyse: Callable[[Column], Column] = words) -> DataFrame:
    """Terms of documents with their frequency: key, length, term, tf; and a row for each document with the term ``""``.

    Only the given terms leave the scan; without any, all do: a table to write once, by hash of the term, and
    to search often. Counting combines in the scan's own task, so the shuffle has a row for each pair.
    """
    tokens = docs.select(key, analyse(F.coalesce(text, F.lit(""))).alias("_t"))
    rows = tokens.select(key, F.size("_t").alias("length"), F.explode(F.array_append("_t", F.lit(""))).alias("term"))
    if terms is not None:
        asked = terms.select("term").distinct().limit(BROADCAST_ROWS + 1).collect()
        if len(asked) <= LISTED_TERMS:
            rows = rows.where(F.col("term").isin(["", *(r.term for r in asked)]))
        else:
            some = terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()
            rows = rows.join(F.broadcast(some) if len(asked) <= BROADCAST_ROWS else some, "term", "left_semi")
    return rows.groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, text: str = "text", key: str = "doc_id", k1: float = 1.2, b: float = 0.75, analyse: Callable[[Column], Column] = words) -> DataFrame:
    """BM25 of every matching document: query_id, key, score, n_terms.

    One scan tokenises: document frequencies, the number of documents and their mean length come from the
    same counted rows as the scores, which Spark computes once (one exchange, read twice).
    """
    terms = query_terms(queries, analyse)
    return score_postings(postings(docs, text, key, terms, analyse), terms, key, k1, b)


def score_postings(found: DataFrame, terms: DataFrame, key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over :func:`postings` (just made, or written before) for terms (query_id, term)."""
    asked = small(terms)
    found = found.join(small(terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()), "term", "left_semi")
    counts = found.groupBy("term").agg(F.count("*").alias("df"), F.avg("length").alias("mean"))
    every = F.col("term") == ""
    # one row, of as many terms as the queries have
    counts = counts.agg(F.collect_list(F.struct("term", "df")).alias("of"), F.max(F.when(every, F.col("df"))).alias("n"), F.max(F.when(every, F.col("mean"))).alias("mean"))
    counts = counts.select("n", "mean", F.inline("of")).where(~every)
    weights = counts.select("term", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    met = found.where(~every).join(F.broadcast(weights) if asked is not terms else weights, "term")
    scored = met.select(key, "term", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))).alias("s"))
    return scored.join(asked, "term").groupBy("query_id", key).agg(F.sum("s").alias("score"), F.count("*").alias("n_terms"))


@dataclass(frozen=True)
class Scored:
    """A column to search, how it is analysed, and how much its score counts."""

    column: str
    weight: float = 1.0
    analyse: Callable[[Column], Column] = words


def bm25_fields(docs: DataFrame, queries: DataFrame, fields: list[Scored], key: str = "doc_id", best: bool = False) -> DataFrame:
    """BM25 over several fields: query_id, key, score. Their weighted scores are added; with ``best`` the highest counts."""
    out = None
    for f in fields:
        own = bm25(docs, queries, f.column, key, analyse=f.analyse).select("query_id", key, (F.lit(f.weight) * F.col("score")).alias("s"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("query_id", key).agg((F.max if best else F.sum)("s").alias("score"))


def phrases_in(docs: DataFrame, phrases: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Which phrases (_p) stand in which documents, in any case, white space as one space: key, _p.

    Phrases are looked for in the scan, ``LISTED_TERMS`` at a time; only hits leave it. A batch of queries has few phrases: they pass
    the driver.
    """
    listed = [r[0] for r in phrases.orderBy("_p").collect()]
    folded = docs.select(key, F.regexp_replace(F.lower(text), r"\s+", " ").alias("_x"))
    out = None
    for lo in range(0, max(len(listed), 1), LISTED_TERMS):
        some = F.array(*map(F.lit, listed[lo : lo + LISTED_TERMS])).cast("array<string>")
        found = folded.select(key, F.explode(F.filter(some, lambda p: F.contains(F.col("_x"), p))).alias("_p"))
        out = found if out is None else out.unionByName(found)
    return out


def number_boosts(scored: DataFrame, docs: DataFrame, queries: DataFrame, weight: float = 3.0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Scores raised where a document holds a number with its unit as the query has it; no document is added.

    ``queries``: query_id, query. A phrase found in few of the scored documents counts for more. The scores are
    written first, as they are read three times.
    """
    scored = Steps(docs.sparkSession, "boosts").write(scored, "scored")
    phrases = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(rf"({PHRASE})"), 1))).alias("_p"))
    phrases = phrases.select("query_id", F.regexp_replace("_p", r"\s+", " ").alias("_p")).distinct()
    hits = phrases_in(docs, phrases.select("_p").distinct(), text, key).join(small(phrases), "_p").join(scored.select("query_id", key), ["query_id", key], "left_semi")
    total = scored.groupBy("query_id").agg(F.count("*").alias("_n"))
    rare = hits.groupBy("query_id", "_p").agg(F.count("*").alias("_d")).join(total, "query_id")
    rare = rare.select("query_id", "_p", F.log(1 + (F.col("_n") - F.col("_d") + 0.5) / (F.col("_d") + 0.5)).alias("_w"))
    boost = hits.join(rare, ["query_id", "_p"]).groupBy("query_id", key).agg((weight * F.sum("_w")).alias("boost"))
    out = scored.join(boost, ["query_id", key], "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    return out.withColumn("score", F.col("score") + F.col("boost"))


def leaders(scored: DataFrame, least: float = 10.0, share: float = 0.6, most: int = 3, key: str = "doc_id") -> DataFrame:
    """Of the names found for each query the first ``most`` that reach ``least`` and ``share`` of the best score."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return top(scored.withColumn("_best", best).where((F.col("score") >= least) & (F.col("score") >= share * F.col("_best"))), most, [F.desc("score"), F.asc(key)], ["query_id"]).drop("_best")


def named_documents(names: DataFrame, queries: DataFrame, generic: list[str] = [], least: float = 10.0, key: str = "doc_id") -> DataFrame:
    """Documents that a query names: the leading ones by BM25 over their names that share a significant word with it."""
    spaced = names.select(key, F.translate("name", "_.-", "   ").alias("name"))
    fields = [Scored("name", 2.0), Scored("name", 1.0, stemmed)]
    scored = bm25_fields(spaced, queries, fields, key, best=True)
    return leaders(scored.join(name_matches(names, queries, generic, key).select("query_id", key), ["query_id", key], "left_semi"), least, key=key)


def top(df: DataFrame, k: int, order: list[Column], by: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1 (Spark prunes groups before the shuffle)."""
    w = Window.partitionBy(*(by or [])).orderBy(*order) if by else Window.partitionBy(F.lit(1)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Exact cosine: the ``k`` nearest rows of each query (query_id, query_vec): query_id, key, cosine, rank.

    Queries are broadcast, in blocks of checked size; each row meets each query in the scan's own task, and
    every task keeps ``k`` rows a query before the shuffle.
    """
    rows = vectors.where(F.col(vec).isNotNull()).select(key, vec, norm(F.col(vec)).alias("_n"))
    asked = queries.select("query_id", "query_vec", norm(F.col("query_vec")).alias("_m"))
    size = F.col("_n") * F.col("_m")
    scored = each_with(rows, asked, "query_id").select("query_id", key, F.when(size > 0, dot(F.col(vec), F.col("query_vec")) / size).otherwise(0.0).alias("cosine"))
    return top(scored, k, [F.desc("cosine"), F.asc(key)], ["query_id"])


def union_candidates(**sources: DataFrame) -> DataFrame:
    """Candidates of several sources, one row for each (query, chunk): best score of each kind, and the sources.

    Each source has query_id, chunk_id and any of doc_id, lex, cos.
    """
    parts = []
    for name, df in sources.items():
        have = {c: F.col(c) for c in df.columns}
        parts.append(df.select("query_id", "chunk_id", have.get("doc_id", F.lit(None).cast("string")).cast("string").alias("doc_id"), have.get("lex", F.lit(None)).cast("double").alias("lex"), have.get("cos", F.lit(None)).cast("double").alias("cos"), F.lit(name).alias("source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "chunk_id").agg(F.max("doc_id").alias("doc_id"), F.max("lex").alias("lex"), F.max("cos").alias("cos"), F.array_sort(F.collect_set("source")).alias("sources"))


def signals(candidates: DataFrame, gate: Gate) -> DataFrame:
    """Adds the signals ``lexical``, ``semantic``, ``by_concept``, their number, and whether the gate opens.

    A candidate passes with two signals, a strong cosine, a concept with a fair cosine, or a named document.
    """
    best = F.max("lex").over(Window.partitionBy("query_id"))
    cos = F.coalesce("cos", F.lit(0.0))
    flagged = candidates.withColumns(
        {
            "lexical": F.coalesce((F.col("lex") > 0) & (F.col("lex") >= gate.lexical_share * best), F.lit(False)),
            "semantic": cos >= gate.semantic,
            "by_concept": F.array_contains("sources", "concept"),
        }
    )
    n = sum(F.col(c).cast("int") for c in ("lexical", "semantic", "by_concept"))
    passes = (n >= 2) | (cos >= gate.strong) | (F.col("by_concept") & (cos >= gate.concept)) | F.array_contains("sources", "name")
    return flagged.withColumns({"n_signals": n, "kept": passes})


def fuse(kept: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of the lexical, the cosine and the concept list: adds ``rrf`` and ``place``."""
    cos, out = F.coalesce("cos", F.lit(0.0)), kept
    lists = {"r_lex": (F.col("lexical"), F.desc("lex")), "r_cos": (F.lit(True), F.desc(cos)), "r_con": (F.col("by_concept"), F.desc(cos))}
    for name, (member, order) in lists.items():
        w = Window.partitionBy("query_id", member).orderBy(order, "chunk_id")
        out = out.withColumn(name, F.when(member, F.row_number().over(w)))
    total = sum(F.coalesce(1.0 / (k + F.col(n)), F.lit(0.0)) for n in lists)
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.desc(cos), "chunk_id")
    return out.withColumn("rrf", total).drop(*lists).withColumn("place", F.row_number().over(w))


def best_per_document(ranked: DataFrame, anew: bool = True) -> DataFrame:
    """The first chunk of each document, placed anew or (without ``anew``) at its place among all chunks."""
    w = Window.partitionBy("query_id", "doc_id").orderBy("place")
    out = ranked.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))) if anew else out


def promote(ranked: DataFrame, named: Column, most: int = CITATIONS, places: int = 2, fixed: bool = False) -> DataFrame:
    """The first ``most`` rows, of which up to ``places`` named ones that were below them take the last places.

    As ordered, a named row in the last places of the window gives way like any other; with ``fixed`` only
    rows that aren't named do.
    """
    by = Window.partitionBy("query_id")
    flagged = ranked.withColumn("_named", named).withColumn("_below", F.col("_named") & (F.col("place") > most))
    flagged = flagged.withColumn("_pick", F.when(F.col("_below"), F.row_number().over(Window.partitionBy("query_id", "_below").orderBy("place"))))
    flagged = flagged.withColumn("_promoted", F.coalesce(F.col("_pick") <= places, F.lit(False)))
    flagged = flagged.withColumn("_n", F.sum(F.col("_promoted").cast("int")).over(by))
    if fixed:
        inside = F.col("place") <= most
        give = F.when(inside & ~F.col("_named"), F.row_number().over(Window.partitionBy("query_id", inside & ~F.col("_named")).orderBy(F.desc("place"))))
        flagged = flagged.withColumn("_give", give)
        chosen = flagged.where(F.col("_promoted") | (inside & (F.coalesce("_give", F.lit(10**9)) > F.col("_n"))))
    else:
        chosen = flagged.where(F.col("_promoted") | (F.col("place") <= most - F.col("_n")))
    order = Window.partitionBy("query_id").orderBy(F.col("_promoted"), "place")
    return chosen.withColumn("citation", F.row_number().over(order)).withColumnRenamed("_promoted", "promoted").drop("_named", "_below", "_pick", "_n", "_give")


def name_matches(names: DataFrame, queries: DataFrame, generic: list[str] = [], key: str = "doc_id") -> DataFrame:
    """Pairs of query and document whose name shares a significant word, but for inflection.

    ``names``: key, name. Words of 4 signs or more, without ``generic`` ones, meet by their first 3 signs.
    """
    def terms(df: DataFrame, c: str, keep: list[str], out: str) -> DataFrame:
        w = F.explode(F.array_distinct(F.filter(words(F.translate(F.col(c), "_.-", "   ")), lambda x: (F.length(x) >= 4) & ~x.isin(*(generic or [""]))))).alias(out)
        return df.select(*keep, w).withColumn("_p", F.left(out, F.lit(3)))

    left = terms(names, "name", [key], "word")
    right = small(terms(queries, "query", ["query_id"], "asked"))
    return left.join(right, "_p").where(same_word(F.col("word"), F.col("asked"))).groupBy("query_id", key).agg(F.countDistinct("asked").alias("n_words"))


def numeric_excerpts(texts: DataFrame, width: int = 260, least: int = 2, key: str = "chunk_id", stems: str | None = None, before: int = 80, lead: int = 0, size: int | None = None) -> DataFrame:
    """The window of ``width`` signs of each text that says most in numbers: key, start, hits, weight, excerpt.

    A window begins at a number; of the windows the one with most of the query's stems (an array column named
    by ``stems``; looked for from ``before`` signs earlier) comes first, then the one that is densest: a decimal
    weighs 3, another number 1. The earliest of the best wins. Texts with fewer than ``least`` numbers in any
    window have no row. The excerpt begins ``lead`` signs earlier and has ``size`` signs (``width`` by default).

    A text is read where it lies, in Arrow batches: windows are differences of running sums, found by bisection
    (columns have no running sum along an array, and a window over numbers would move the text with each).
    """
    kind = dict(texts.dtypes)[key]
    asked = F.col(stems) if stems else F.array().cast("array<string>")
    rows = texts.where(F.col("text").rlike(r"\d")).select(key, "text", asked.alias("_stems"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_densest(t, w, width, least, before) for t, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            rows = [i for i, x in enumerate(found) if x]
            cut = [b.column(1)[i].as_py()[max(found[i][0] - lead, 0) :][: size or width] for i in rows]
            numbers = [pa.array([found[i][k] for i in rows], pa.int64()) for k in range(3)]
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), *numbers, pa.array(cut, pa.string())], [key, "start", "hits", "weight", "excerpt"])

    return rows.mapInArrow(work, f"`{key}` {kind}, start long, hits long, weight long, excerpt string")


def _densest(text: str, stems: list[str] | None, width: int, least: int, before: int) -> tuple[int, int, int] | None:
    """Start, hits and weight of the best window of a text."""
    found = [(m.start(), 3 if "," in m[0] or "." in m[0] else 1) for m in _NUMBER.finditer(text)]
    if len(found) < least:
        return None
    starts, weights = np.array(found).T
    sums = np.concatenate([[0], np.cumsum(weights)])
    last = np.searchsorted(starts, starts + width, "right")
    at = np.flatnonzero(last - np.arange(len(starts)) >= least)
    if not len(at):
        return None
    hits = np.zeros(len(at), np.int64)
    if stems:
        for k, p in enumerate(starts[at].tolist()):
            own = text[max(p - before, 0) : p + width].lower()
            hits[k] = sum(w in own for w in stems)
    weight = sums[last[at]] - sums[at]
    best = np.lexsort((starts[at], -weight, -hits))[0]
    return int(starts[at[best]]), int(hits[best]), int(weight[best])


def best_in_documents(scored: DataFrame, cited: DataFrame, texts: DataFrame, best: int = 3) -> DataFrame:
    """Places beside citations where more evidence may stand: query_id, doc_id, seq, origin.

    Of each cited document (query_id, doc_id) the ``best`` chunks by ``scored`` (query_id, chunk_id, score; ties to the
    smaller chunk_id) as ``inside``, and the chunks before and after them as ``beside``. ``texts``: chunk_id,
    doc_id, seq; only these three columns move.
    """
    own = scored.join(texts.select("chunk_id", "doc_id", "seq"), "chunk_id").join(cited.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    found = top(own, best, [F.desc("score"), F.asc("chunk_id")], ["query_id", "doc_id"])
    places = F.array(*[F.struct((F.col("seq") + k).alias("seq"), F.lit("beside" if k else "inside").alias("origin")) for k in (0, -1, 1)])
    return found.select("query_id", "doc_id", F.inline(places)).groupBy("query_id", "doc_id", "seq").agg(F.max("origin").alias("origin"))


def number_evidence(cited: DataFrame, texts: DataFrame, stems: DataFrame, most: int = 4, skip: int = 260, more: DataFrame | None = None) -> DataFrame:
    """Numeric evidence beside citations: query_id, chunk_id, rank, origin, excerpt.

    ``cited``: query_id, chunk_id, doc_id, seq; ``texts``: chunk_id, doc_id, seq, text; ``stems``: query_id,
    stems. Origins are what follows the first ``skip`` signs of the cited chunk itself, and the chunks before
    and after it in its document, and the places in ``more`` (query_id, doc_id, seq, origin), as of
    :func:`best_in_documents` or of conditions; of each query and document the best ``most`` stay.
    """
    near = cited.select("query_id", "doc_id", F.explode(F.array(*[F.struct((F.col("seq") + k).alias("seq"), F.lit(o).alias("origin")) for k, o in ((0, "own"), (-1, "before"), (1, "after"))])).alias("n"))
    near = near.select("query_id", "doc_id", "n.seq", "n.origin")
    near = near.unionByName(more.select("query_id", "doc_id", "seq", "origin")) if more is not None else near
    near = near.groupBy("query_id", "doc_id", "seq").agg(F.max("origin").alias("origin"))
    met = texts.join(near, ["doc_id", "seq"]).join(small(stems), "query_id")
    met = met.withColumns({"text": F.when(F.col("origin") == "own", F.substring("text", skip + 1, 1 << 30)).otherwise(F.col("text")), "_k": F.struct("query_id", "doc_id", "chunk_id", "origin")})
    found = numeric_excerpts(met, key="_k", stems="stems", lead=60, size=360).select("_k.*", "hits", "weight", "excerpt")
    return top(found, most, [F.desc("hits"), F.desc("weight"), F.asc("chunk_id")], ["query_id", "doc_id"]).select("query_id", "chunk_id", "rank", "origin", "excerpt")


def neighbours(chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The texts before and after each chunk of a document. ``keys``: document and place columns."""
    w = Window.partitionBy(keys[0]).orderBy(*keys[1:])
    return chunks.withColumns({"before": F.lag(text).over(w), "after": F.lead(text).over(w)})


def citations(chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """Citations with the first 400 signs of their chunk and rounded scores."""
    return chosen.join(texts.select("chunk_id", "text"), "chunk_id", "left").withColumns({"quote": F.substring("text", 1, QUOTE), "rrf": F.bround("rrf", 5), "cos": F.bround("cos", 4)}).drop("text")
