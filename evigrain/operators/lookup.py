"""Lookups, filters and small summaries over the lake's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import holding
from ..functions.numbers import number_in_text, numbers_in
from ..functions.text import fold, sentences, words
from ..functions.vectors import norm, unit
from .ranking import small

#: Filters a search takes, by the column they test.
EQUAL_FILTERS = ("geography", "section", "doc_id", "source_type", "domain")


def active(filters: dict[str, object]) -> dict[str, object]:
    """Filters that say something: not None, empty or ``all``."""
    return {k: v for k, v in filters.items() if v is not None and v != "" and v != "all"}


def predicate(filters: dict[str, object]) -> Column:
    """One condition for all filters: equality, ``year_from``, ``year_to``, ``confidence_min``; nulls fail in ``where``.

    Plain comparisons, so that scans can be pruned by them.
    """
    out = F.lit(True)
    for k, v in active(filters).items():
        if k == "year_from":
            out = out & (F.col("year") >= v)
        elif k == "year_to":
            out = out & (F.col("year") <= v)
        elif k == "confidence_min":
            out = out & (F.col("confidence") >= v)
        elif k in EQUAL_FILTERS:
            out = out & (F.col(k) == v)
        else:
            raise ValueError(f"unknown filter {k!r}")
    return out


def not_fixture(doc_id: Column) -> Column:
    """Whether a document's id is outside the numbers kept for test documents (fixed pattern)."""
    return ~doc_id.rlike(r"^d0009\d\d$")


def numeric_conditions(conditions: DataFrame, part: str | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """Conditions whose parameter holds ``part`` (in any case) and whose value lies between the bounds given."""
    out = conditions.where(F.contains(F.lower("param"), F.lit(part.lower()))) if part else conditions
    out = out.where(F.col("value") >= least) if least is not None else out
    return out.where(F.col("value") <= most) if most is not None else out


def by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows with one of the ids (key); the ids are broadcast by checked size."""
    return table.join(small(ids.select(key).distinct()), key, "left_semi")


def with_fallback(ids: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Each id with its value in ``first``, else in ``second``; ``found`` says where."""
    one = first.select(key, F.col(value).alias("_a"))
    two = second.select(key, F.col(value).alias("_b"))
    out = ids.select(key).distinct().join(one, key, "left").join(two, key, "left")
    found = F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second")
    return out.select(key, F.coalesce("_a", "_b").alias(value), found.alias("found"))


def first_chunks(chunks: DataFrame, n: int, by: str = "doc_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The first ``n`` chunks of each document."""
    w = Window.partitionBy(by).orderBy(*order)
    return chunks.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def promoted(nodes: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Nodes with properties as columns of their own (property -> type)."""
    return nodes.withColumns({k: F.col("props")[k].try_cast(t) for k, t in keys.items()})


def edge_ids(edges: DataFrame) -> DataFrame:
    """Edges with an id of their ends and type where they have none."""
    return edges.withColumn("edge_id", F.coalesce("edge_id", F.concat_ws("|", "src", "type", "dst")))


def unit_vectors(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Vectors of length one, with their first length."""
    return vectors.withColumn("norm", norm(F.col(vec))).withColumn(vec, unit(F.col(vec)))


def evidence_touching(assertions: DataFrame, kept: DataFrame) -> DataFrame:
    """Assertions (query_id, id, docs) of queries (query_id, doc_id) whose evidence is among the kept documents, or
    that have none; a query that none of its assertions passes keeps them all."""
    docs = kept.groupBy("query_id").agg(F.collect_set("doc_id").alias("_kept"))
    both = assertions.join(docs, "query_id", "left")
    touches = (F.size(F.coalesce("docs", F.array())) == 0) | F.coalesce(F.arrays_overlap("docs", "_kept"), F.lit(False))
    any_ = F.max(touches.cast("int")).over(Window.partitionBy("query_id"))
    return both.withColumn("_t", touches).withColumn("_any", any_).where(F.col("_t") | (F.col("_any") == 0)).drop("_t", "_any", "_kept")


def term_match(terms: DataFrame, forms: DataFrame, least: int = 4) -> DataFrame:
    """Each term's concept: its form exactly, else the longest form of ``least`` signs in it or around it.

    ``terms``: term; ``forms``: concept_id, form. Exact matches meet by equality; the rest by the first ``least``
    signs of the one that is to be inside, which stand somewhere in the other, and are then compared.
    """
    t = terms.select("term").distinct().withColumn("_t", fold(F.col("term")))
    f = forms.select("concept_id", fold(F.col("form")).alias("form"))
    exact = t.join(f, t["_t"] == f["form"]).groupBy("term").agg(F.min("concept_id").alias("concept_id")).withColumn("tier", F.lit("exact"))
    rest = t.join(exact.select("term"), "term", "left_anti").where(F.length("_t") >= least)
    f = f.where(F.length("form") >= least)

    def runs(c: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(c) - (least - 1))
        return F.explode(F.array_distinct(F.transform(starts, lambda i: c.substr(i, F.lit(least)))))

    head = lambda c: F.left(c, F.lit(least))
    term, form = F.col("_t"), F.col("form")
    outer = rest.withColumn("_g", runs(term)).join(small(f.withColumn("_g", head(form))), "_g").where(F.contains(term, form))
    inner = rest.withColumn("_g", head(term)).join(small(f.withColumn("_g", runs(form))), "_g").where(F.contains(form, term))
    near = outer.unionByName(inner).groupBy("term").agg(F.min_by("concept_id", F.struct(-F.length("form"), F.col("form"), F.col("concept_id"))).alias("concept_id"))
    return exact.unionByName(near.withColumn("tier", F.lit("part")))


def longest_alias(docs: DataFrame, aliases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The longest alias (concept_id, alias) contained in each text, all looked for in one pass over it."""
    low = docs.select(key, F.lower(text).alias("_t"))
    asked = aliases.select("concept_id", F.lower("alias").alias("alias"))
    hits = holding(low, [key], "_t", asked, "alias").join(small(asked), "alias")
    return hits.groupBy(key).agg(F.min_by(F.struct("concept_id", "alias"), F.struct(-F.length("alias"), F.col("alias"), F.col("concept_id"))).alias("b")).select(key, "b.*")


def language_rollup(chunks: DataFrame, by: str = "doc_id", lang: str = "lang") -> DataFrame:
    """A document's language: that of all its chunks, else ``mixed``."""
    out = chunks.groupBy(by).agg(F.min(lang).alias("_a"), F.max(lang).alias("_b"))
    return out.select(by, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("mixed").alias("lang"))


def confidence_summary(evidence: DataFrame, by: str, label: str = "confidence") -> DataFrame:
    """Evidence by confidence, and an overall one: high if any is, else medium if there is any, else low."""
    n = {k: F.count_if(F.col(label) == k).alias(f"n_{k}") for k in ("high", "medium", "low")}
    overall = F.when(F.count_if(F.col(label) == "high") > 0, "high").when(F.count(label) > 0, "medium").otherwise("low")
    return evidence.groupBy(by).agg(*n.values(), overall.alias("overall"))


def data_version(**tables: DataFrame) -> DataFrame:
    """One row: the tables' row counts, and their hash, which changes with any of them."""
    out = None
    for name in sorted(tables):
        n = tables[name].agg(F.count("*").alias(name))
        out = n if out is None else out.crossJoin(n)
    return out.withColumn("version", F.sha2(F.concat_ws("|", *sorted(tables)), 256))


def off_topic(intents: DataFrame) -> DataFrame:
    """Queries (foreign, domain: arrays of concepts) that name foreign materials and nothing of the domain."""
    mixed = F.size(F.array_intersect("foreign", "domain"))
    return intents.withColumn("rejected", (F.size("foreign") > 0) & ((F.size("domain") == 0) | (mixed == F.size("domain"))))


def supported_sentences(answers: DataFrame, key: str = "query_id", answer: str = "answer", evidence: str = "evidence") -> DataFrame:
    """Answers without the sentences whose numbers aren't all in the evidence; table rows stay."""
    def good(s: Column) -> Column:
        return F.startswith(F.ltrim(s), F.lit("|")) | F.forall(numbers_in(F.regexp_replace(s, r"\[\d+\]", "")), lambda n: number_in_text(n, F.col(evidence)))

    kept = F.filter(sentences(F.col(answer)), good)
    return answers.select(key, F.array_join(kept, " ").alias("answer"), (F.size(sentences(F.col(answer))) - F.size(kept)).alias("n_dropped"))


def adjacent_topics(concepts: DataFrame, queries: DataFrame, most: int = 5) -> DataFrame:
    """For queries without an answer: up to ``most`` concepts (concept_id, label) that share a word's beginning."""
    c = concepts.select("concept_id", "label", F.explode(F.array_distinct(words(F.col("label")))).alias("_w")).withColumn("_p", F.left("_w", F.lit(4)))
    q = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("_q")).withColumn("_p", F.left("_q", F.lit(4)))
    hits = c.where(F.length("_w") >= 4).join(small(q.where(F.length("_q") >= 4)), "_p").select("query_id", "concept_id", "label").distinct()
    w = Window.partitionBy("query_id").orderBy("label", "concept_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def gaps(queries: DataFrame, assertions: DataFrame) -> DataFrame:
    """Queries (query_id, n_numbers) with numeric constraints but no assertion (query_id, docs) that has evidence."""
    held = assertions.where(F.size("docs") > 0).select("query_id").distinct()
    return queries.where("n_numbers > 0").join(held, "query_id", "left_anti").select("query_id", F.lit("no measured evidence").alias("gap"))
