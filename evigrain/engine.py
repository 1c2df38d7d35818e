"""One object over the lake's tables, with a method for each request the service answers.

Every method returns a DataFrame (or a pair), lazily; requests over many queries, ids or roles are tables, so
a batch costs one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sinks
from .operators import graph, lookup, ranking, reach, state
from .operators.ranking import Gate
from .plans import build
from .plans import search as plan


@dataclass
class Engine:
    """Tables by name: documents, chunks, nodes, edges, conditions, vectors, concepts, audit, subscriptions."""

    tables: dict[str, DataFrame]
    gate: Gate = field(default_factory=Gate)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError as e:
            raise AttributeError(name) from e

    def health(self) -> DataFrame:
        """Row counts and the data's version."""
        return lookup.data_version(**self.tables)

    def capabilities(self, roles: DataFrame) -> DataFrame:
        """What each role (role) may do."""
        spark = roles.sparkSession
        known = spark.createDataFrame([(r, c) for r, cs in state.CAPABILITIES.items() for c in cs], "role string, capability string")
        return roles.join(F.broadcast(known), "role")

    def search(self, queries: DataFrame, filters: dict[str, object] | None = None, role: str = "researcher") -> DataFrame:
        """Citations for queries (query_id, query, query_vec, label): filtered and role-checked in every branch.

        ``documents``: doc_id, text and the filters' columns; ``vectors``: vec_id, embedding, label. Queries
        whose candidates all fail the gate have no row. Where documents have a ``name``, those that a query
        names are candidates and are promoted.
        """
        docs = self.documents.where(lookup.predicate(filters or {}))
        if "sensitivity" in docs.columns:
            docs = docs.where(state.may_see(F.lit(role), F.col("sensitivity")))
        vectors = self.vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
        named = ranking.named_documents(docs.select("doc_id", "name"), queries, least=self.gate.named) if "name" in docs.columns else None
        return plan.cited(plan.evidence(docs, vectors, queries, self.gate, "doc_id", named), F.array_contains("sources", "name"))

    def node(self, ids: DataFrame, depth: int = 1) -> DataFrame:
        """Nodes within ``depth`` (1 to 4) steps of each id (start), themselves included."""
        near = reach.within_hops(self.edges, ids, min(max(depth, 1), 4))
        return near.join(self.nodes, "id")

    def overview(self, limit: int = 300) -> tuple[DataFrame, DataFrame]:
        return graph.overview(self.nodes, self.edges, min(max(limit, 1), 2000))

    def find_concepts(self, kind: str | None = None, text: str | None = None, limit: int = 50, comparable: int = 2) -> DataFrame:
        """Concepts by type and part of a name: those with ``comparable`` links or more first, then by links."""
        hits = self.nodes
        hits = hits.where(F.col("type") == kind) if kind else hits
        hits = hits.where(F.contains(F.lower("name"), F.lit(text.lower()))) if text else hits
        out = hits.join(graph.degrees(self.edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        out = out.withColumn("comparable", F.col("degree") >= comparable)
        return out.orderBy(F.desc("comparable"), F.desc("degree"), F.lower("name"), "id").limit(min(max(limit, 1), 200))

    def document(self, ids: DataFrame, role: str = "researcher", most: int = 100) -> DataFrame:
        """Documents (doc_id) the role may see, with up to ``most`` chunks in order."""
        docs = lookup.by_ids(self.documents, ids, "doc_id")
        docs = docs.where(state.may_see(F.lit(role), F.col("sensitivity"))) if "sensitivity" in docs.columns else docs
        own = lookup.first_chunks(lookup.by_ids(self.chunks, ids, "doc_id"), most)
        parts = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "text"))).alias("chunks"))
        return docs.drop("text").join(parts, "doc_id", "left")

    def experts(self, topic: str | None = None, limit: int = 20) -> DataFrame:
        """People by distinct publications, of a topic if one is given."""
        people = self.nodes.where("type = 'Expert'").select(F.col("id").alias("expert"), "name")
        both = graph.undirected(self.edges).join(people, F.col("a") == F.col("expert"))
        linked = both.join(self.nodes.select(F.col("id").alias("b"), F.col("type").alias("_t"), F.col("name").alias("_n")), "b")
        if topic:
            low = F.lit(topic.lower())
            match = linked.where(F.contains(F.lower("name"), low) | F.contains(F.lower("_n"), low)).select("expert").distinct()
            linked = linked.join(match, "expert", "left_semi")
        return graph.ranked_experts(linked.where("_t = 'Publication'").select("expert", F.col("b").alias("work")), limit)

    def stats(self) -> DataFrame:
        """Counts of nodes and edges by type, and of documents by section, language and year."""
        parts = [self.nodes.groupBy(F.col("type").alias("value")).agg(F.count("*").alias("n")).select(F.lit("node").alias("facet"), "value", "n"), self.edges.groupBy(F.col("type").alias("value")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("facet"), "value", "n")]
        have = [c for c in ("section", "lang", "year") if c in self.documents.columns]
        if have:
            facet = F.coalesce(*[F.when(F.grouping(c) == 0, c) for c in have])
            sets = self.documents.groupingSets([[c] for c in have], *have).agg(facet.alias("facet"), F.count("*").alias("n"))
            parts.append(sets.select("facet", F.coalesce(*[F.col(c).cast("string") for c in have]).alias("value"), "n"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def compare(self, one: str, two: str) -> DataFrame:
        """The conditions of two processes side by side, by parameter."""
        c = self.conditions.where(F.col("process_id").isin(one, two)).withColumn("_s", F.concat_ws(" ", "op", F.col("value").cast("string"), "unit"))
        return c.groupBy("param").pivot("process_id", [one, two]).agg(F.array_join(F.array_sort(F.collect_set("_s")), "; "))

    def updates(self, items: DataFrame) -> DataFrame:
        """Items (topic, at, ...) newer than the cursor of each subscription (sub_id, topic, cursor)."""
        return state.updates_since(items, self.subscriptions, "topic", "at", "cursor")

    def advanced(self, items: DataFrame) -> DataFrame:
        """The subscriptions with their cursors at the newest item of their topic."""
        newest = items.groupBy("topic").agg(F.max("at").alias("_m"))
        return self.subscriptions.join(newest, "topic", "left").withColumn("cursor", F.greatest("cursor", "_m")).drop("_m")

    def edit_edges(self, edits: DataFrame, order: tuple[str, ...] = ("edited_at",)) -> DataFrame:
        """All versions of the edges after edits; ``graph.current`` gives the last."""
        return graph.revise(self.edges, edits, order=order)

    def review(self, verdicts: DataFrame) -> DataFrame:
        """Nodes with the last verdict (id, status, at) on each; others are ``auto``."""
        from .schemas import REVIEW_STATES

        last = state.latest(verdicts.where(F.col("status").isin(*REVIEW_STATES)), "id", "at").select("id", F.col("status").alias("review_status"))
        return self.nodes.join(last, "id", "left").withColumn("review_status", F.coalesce("review_status", F.lit("auto")))

    def audit_log(self, action: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        log = self.audit.where(F.col("action") == action) if action else self.audit
        return state.page(log, "id", offset, min(limit, 1000))

    def answer_text(self, cited: DataFrame) -> DataFrame:
        """The evidence of each query as markdown."""
        texts = self.documents.select(F.col("doc_id").alias("chunk_id"), "text")
        return plan.packet(ranking.citations(cited, texts))

    def upload(self, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Documents, chunks and jobs of uploaded files (path, content); ``manifest`` says what is known."""
        return build.uploaded(files, self.manifest)

    def export(self, cited: DataFrame, form: str = "markdown") -> DataFrame:
        """The evidence of each query as ``markdown``, ``json`` or ``jsonld``: query_id, body."""
        if form == "markdown":
            return self.answer_text(cited).select("query_id", F.col("markdown").alias("body"))
        texts = self.documents.select(F.col("doc_id").alias("chunk_id"), "text")
        rows = ranking.citations(cited, texts).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation", "chunk_id", "doc_id", "quote"))).alias("citations"))
        if form == "json":
            return rows.select("query_id", F.to_json(F.struct("query_id", "citations")).alias("body"))
        if form == "jsonld":
            return rows.select("query_id", sinks.json_ld(F.col("query_id").cast("string"), {"wasDerivedFrom": F.col("citations")}).alias("body"))
        raise ValueError(f"unknown form {form!r}")

    def subscribe(self, changes: DataFrame) -> DataFrame:
        """The subscriptions after changes (sub_id, action, at, fields)."""
        return state.subscribed(self.subscriptions, changes)

    def cache_cleared(self) -> DataFrame:
        """The answer cache without entries; write it over the old one."""
        return self.answer_cache.limit(0)
