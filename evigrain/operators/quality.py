"""Declarative constraints, and scores of retrieval results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraint:
    """A rule on one column: ``required``, ``number``, ``one_of``, ``at_least``, ``at_most`` or ``matches``."""

    path: str
    kind: str
    arg: object = None
    severity: str = "violation"

    @property
    def message(self) -> str:
        return self.kind if self.arg is None else f"{self.kind} {','.join(map(str, self.arg)) if isinstance(self.arg, tuple) else self.arg}"

    def broken(self) -> Column:
        c = F.col(self.path)
        rules = {
            "required": lambda: c.isNull() | (F.trim(c.cast("string")) == ""),
            "number": lambda: c.isNotNull() & c.cast("string").try_cast("double").isNull(),
            "one_of": lambda: c.isNotNull() & ~c.isin(*self.arg),
            "at_least": lambda: c < self.arg,
            "at_most": lambda: c > self.arg,
            "matches": lambda: c.isNotNull() & ~c.rlike(self.arg),
        }
        return F.coalesce(rules[self.kind](), F.lit(False))


def violations(df: DataFrame, key: str, constraints: list[Constraint]) -> DataFrame:
    """One row for each broken constraint of each row: key, path, message, severity. One scan, no join."""
    found = [F.when(c.broken(), F.struct(F.lit(c.path).alias("path"), F.lit(c.message).alias("message"), F.lit(c.severity).alias("severity"))) for c in constraints]
    return df.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*found))).alias("v")).select("key", "v.*")


def report(found: DataFrame, examples: int = 3) -> DataFrame:
    """Violations by path and message, the most frequent first, with a few examples (the smallest keys).

    Examples are kept in a bounded heap for each group: no list of all keys is gathered.
    """
    n = found.groupBy("path", "message", "severity").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    ranked = found.withColumn("_k", F.expr("row_number() over (partition by path, message, severity order by key)")).where(F.col("_k") <= examples)
    few = ranked.groupBy("path", "message", "severity").agg(F.array_sort(F.collect_list("key")).alias("examples"))
    return n.join(few, ["path", "message", "severity"]).drop("first").orderBy(F.desc("n"), "path", "message")


def retrieval_scores(results: DataFrame, expected: DataFrame) -> DataFrame:
    """For each query its hit, recall and honesty.

    ``results``: query_id, doc_id; ``expected``: query_id, docs (array), expect_empty.
    """
    found = results.groupBy("query_id").agg(F.collect_set("doc_id").alias("found"))
    both = expected.join(found, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    hits = F.size(F.array_intersect("docs", "found"))
    empty = F.size("found") == 0
    return both.select("query_id", F.when(F.size("docs") > 0, (hits > 0).cast("int")).alias("hit"), F.when(F.size("docs") > 0, hits / F.size("docs")).alias("recall"), F.when(F.col("expect_empty"), empty.cast("int")).alias("honest"))


#: How an answer says that nothing was found.
NOT_FOUND = ("не найден", "нет данных", "not found", "no data")


def number_stands(text: Column, number: Column) -> Column:
    """Whether a number stands in a text as it is, or with a comma for its dot, or a dot for its comma."""
    n = F.trim(number)
    return (n != "") & (F.contains(text, n) | F.contains(text, F.translate(n, ",", ".")) | F.contains(text, F.translate(n, ".", ",")))


def answer_scores(cases: DataFrame, answers: DataFrame, citations: DataFrame, labels: DataFrame) -> DataFrame:
    """Each case's scores: doc_hit, doc_recall, num_ok, num_recall, cite_ok, honest, said_not_found; null where not asked.

    ``cases``: query_id, query, must_docs (patterns), must_numbers (strings), must_cite, expect_empty;
    ``answers``: query_id, answer; ``citations``: query_id, doc_id, quote; ``labels``: doc_id, label. Patterns are
    looked for in the labels of cited documents, in any case; numbers in the quotes and in the answer, from
    which the query's own words are taken out first, so that an echo proves nothing.
    """
    cited = citations.join(labels, "doc_id", "left").groupBy("query_id").agg(
        F.array_sort(F.collect_set(F.lower(F.coalesce("label", F.col("doc_id").cast("string"))))).alias("_labels"), F.array_join(F.array_sort(F.collect_list(F.coalesce("quote", F.lit("")))), " ").alias("_quotes"), F.count("*").alias("_n")
    )
    rows = cases.join(answers, "query_id", "left").join(cited, "query_id", "left")
    said = F.coalesce("answer", F.lit(""))
    told = F.concat(F.when(F.coalesce("query", F.lit("")) != "", F.replace(said, F.col("query"), F.lit(""))).otherwise(said), F.lit("\n"), F.coalesce("_quotes", F.lit("")))
    found_docs = F.size(F.filter("must_docs", lambda p: F.exists(F.coalesce("_labels", F.array().cast("array<string>")), lambda x: F.contains(x, F.lower(p)))))
    found_numbers = F.size(F.filter("must_numbers", lambda n: number_stands(told, n)))
    docs, numbers = F.coalesce(F.size("must_docs"), F.lit(0)), F.coalesce(F.size("must_numbers"), F.lit(0))
    has = F.coalesce("_n", F.lit(0)) > 0
    not_found = F.lit(False)
    for mark in NOT_FOUND:
        not_found = not_found | F.contains(F.lower(said), F.lit(mark))
    return rows.select(
        "query_id",
        F.when(docs > 0, found_docs > 0).alias("doc_hit"),
        F.when(docs > 0, F.round(found_docs / docs, 2)).alias("doc_recall"),
        F.when(numbers > 0, found_numbers == numbers).alias("num_ok"),
        F.when(numbers > 0, F.round(found_numbers / numbers, 2)).alias("num_recall"),
        F.when(F.col("must_cite"), has).alias("cite_ok"),
        F.when(F.col("expect_empty"), ~has).alias("honest"),
        F.when(F.col("expect_empty"), not_found).alias("said_not_found"),
    )


def metric_means(scores: DataFrame) -> DataFrame:
    """One row: the mean of each score over the cases that have it, and how many those are."""
    flags = [(c, F.col(c).cast("double")) for c in scores.columns if c != "query_id"]
    return scores.agg(*[F.round(F.avg(v), 4).alias(c) for c, v in flags], *[F.count(v).alias(f"n_{c}") for c, v in flags])
