"""Batch plans: files to documents and chunks; model payloads to the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matching import holding
from ..functions.paths import metadata
from ..functions.payloads import coerced, confidence, problem, repaired
from ..functions.text import fold, grounded, slug
from ..functions.units import canonical_unit, canonical_value
from ..operators import chunking, graph, state
from ..operators.ranking import small
from ..schemas import NODE_PREFIXES, PAYLOAD
from ..scratch import Steps
from ..sources import files as sources
from ..sources.tables import spread


def manifest(files: DataFrame, known: DataFrame) -> DataFrame:
    """New contents of files (path, content) with ids and path metadata; ``known``: sha256, doc_no. Files without content (failed members) aren't in it."""
    fresh = state.first_by_content(files.where("content IS NOT NULL").withColumn("sha256", F.sha2("content", 256)))
    numbered = state.new_ids(fresh, known)
    return numbered.withColumn("m", metadata(F.col("path"))).select("*", "m.*").drop("m")


def documents(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of new files. Write the manifest first where the files are many: both read it."""
    new = manifest(files, known)
    pages = sources.pages(new).join(new.select("path", "doc_id"), "path").where("status = 'ok'").select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))
    chunks = chunking.chunk_documents(chunking.strip_repeated(pages))
    head = chunks.groupBy("doc_id").agg(F.min_by("section_title", F.when(F.col("section_title").isNotNull(), F.col("seq"))).alias("title"), F.count("*").alias("n_chunks"), F.min("lang").alias("_a"), F.max("lang").alias("_b"))
    out = new.drop("content").join(head, "doc_id", "left").withColumn("lang", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("mixed"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    return out.withColumn("title", F.coalesce("title", stem)).drop("_a", "_b"), chunks


def _node_id(kind, name):
    prefixes = F.create_map(*[F.lit(x) for kv in NODE_PREFIXES.items() for x in kv])
    return F.concat(F.coalesce(prefixes[kind], F.lit("node")), F.lit(":"), slug(name))


def payload_graph(extractions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and rejected rows of model answers (chunk_id, doc_id, text, payload).

    Entities become nodes; relations become edges where both ends are entities of the same chunk; assertions
    become nodes where their quote stands in the chunk; conditions become nodes with canonical values. An answer is
    read once, on all cores, and written: each kind of row is taken from there.
    """
    rows = spread(extractions).withColumn("_json", repaired(F.col("payload"))).withColumn("x", F.from_json("_json", PAYLOAD))
    rows = rows.select("chunk_id", "doc_id", "text", "x", problem(F.col("payload"), F.col("_json"), F.col("x")).alias("problem"))
    rows = Steps(extractions.sparkSession, "payloads").write(rows, "rows")
    bad = rows.where("problem is not null").select("chunk_id", "problem")
    ok = rows.where("problem is null").select("chunk_id", "doc_id", "text", "x")
    e = ok.select("chunk_id", "doc_id", F.explode("x.entities").alias("e")).where(F.length(F.trim("e.name")) > 0)
    e = e.select("chunk_id", "doc_id", _node_id(F.col("e.type"), F.col("e.name")).alias("id"), F.col("e.type").alias("type"), F.trim("e.name").alias("name"), F.col("e.name_en").alias("name_en"))
    nodes = e.select("id", "type", "name", "name_en", F.array("name").alias("aliases"), F.array("doc_id").alias("source_docs"), F.lit(0.7).alias("confidence"), F.col("chunk_id").alias("ord"))
    a = ok.select("chunk_id", "doc_id", "text", F.explode("x.assertions").alias("a")).where(grounded(F.col("a.quote"), F.col("text")))
    facts = a.select(F.concat(F.lit("assert:"), F.substring(F.sha1(F.concat_ws("|", "chunk_id", "a.statement")), 1, 10)).alias("id"), F.lit("Assertion").alias("type"), F.col("a.statement").alias("name"), F.lit(None).cast("string").alias("name_en"), F.array().cast("array<string>").alias("aliases"), F.array("doc_id").alias("source_docs"), confidence(F.col("a.confidence")).alias("confidence"), F.col("chunk_id").alias("ord"))
    c = ok.select("chunk_id", "doc_id", F.explode("x.conditions").alias("c")).withColumn("v", coerced(F.col("c.value"))).where("v is not null")
    value, unit = canonical_value(F.col("v"), F.col("c.unit")), canonical_unit(F.col("c.unit"))
    op = F.coalesce(F.col("c.op"), F.lit("="))
    label = F.concat_ws(" ", F.col("c.param"), op, value.cast("string"), unit)
    cid = F.concat_ws(":", F.lit("cond"), slug(F.col("c.param")), op, F.replace(value.cast("string"), F.lit("."), F.lit("_")), slug(F.coalesce(unit, F.lit(""))))
    conds = c.select(cid.alias("id"), F.lit("Condition").alias("type"), label.alias("name"), F.lit(None).cast("string").alias("name_en"), F.array().cast("array<string>").alias("aliases"), F.array("doc_id").alias("source_docs"), F.lit(0.7).alias("confidence"), F.col("chunk_id").alias("ord"))
    r = ok.select("chunk_id", "doc_id", F.explode("x.relations").alias("r"))
    ends = e.select("chunk_id", fold(F.col("name")).alias("n"), "id")
    r = r.select("chunk_id", "doc_id", fold(F.col("r.src")).alias("s"), fold(F.col("r.dst")).alias("t"), F.col("r.type").alias("type"))
    r = r.join(ends.select("chunk_id", F.col("n").alias("s"), F.col("id").alias("src")), ["chunk_id", "s"]).join(ends.select("chunk_id", F.col("n").alias("t"), F.col("id").alias("dst")), ["chunk_id", "t"])
    edges = r.select(graph.edge_key(F.col("src"), F.col("type"), F.col("dst")).alias("edge_id"), "src", "dst", "type", F.create_map().cast("map<string,string>").alias("props"), F.col("doc_id").alias("source_doc"), "chunk_id")
    return graph.merge_nodes(nodes.unionByName(facts).unionByName(conds), "ord"), graph.clean_edges(edges), bad


def condition_table(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with a numeric condition, the edge's own values before its end node's; a value of 0 stays."""
    n = nodes.select(F.col("id").alias("dst"), *[F.col("props")[k].alias(f"_{k}") for k in ("param", "op", "value", "unit")])
    out = edges.join(n, "dst", "left")
    pick = {k: F.coalesce(F.col("props")[k], F.col(f"_{k}")) for k in ("param", "op", "value", "unit")}
    out = out.select("edge_id", "src", "dst", *[c.alias(k) for k, c in pick.items()], "source_doc", "chunk_id").withColumn("value", F.col("value").try_cast("double"))
    return out.where("param is not null or value is not null")


def known_conditions(found: DataFrame, registry: DataFrame, require: bool = True) -> DataFrame:
    """Conditions (param, quote, ...) with the registry's parameter they are about: adds param_concept and label.

    ``registry``: concept_id, type, form, label. A parameter is known by its form exactly, else by the longest
    form in the name and quote; a concept of another type isn't one. With ``require`` the others are dropped, as
    conditions that rules find in running text must be; model answers keep theirs without a concept.
    """
    forms = registry.select("concept_id", "type", fold(F.col("form"), yo=True).alias("_form"), "label").where("_form <> ''")
    rows = found.withColumns({"_k": F.xxhash64(F.coalesce("param", F.lit("")), F.coalesce("quote", F.lit(""))), "_p": fold(F.coalesce("param", F.lit("")), yo=True)})
    rows = rows.withColumn("_t", fold(F.concat_ws(" ", "param", "quote"), yo=True))
    asked = rows.select("_k", "_p", "_t").distinct()
    inside = holding(asked, ["_k", "_p"], "_t", forms, "_form")
    hits = inside.unionByName(asked.select("_k", "_p", F.col("_p").alias("_form"))).distinct().join(small(forms), "_form")
    best = hits.groupBy("_k").agg(F.max_by(F.struct("concept_id", "type", "label"), F.struct((F.col("_p") == F.col("_form")).cast("int"), F.length("_form"), "_form")).alias("r")).select("_k", "r.*")
    own = best.where("type = 'Parameter'").select("_k", F.col("concept_id").alias("param_concept"), "label")
    return rows.join(own, "_k", "inner" if require else "left").drop("_k", "_p", "_t")


def with_places(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Nodes (id, source_docs, props) with the countries of their documents (doc_id, countries) united into ``props``."""
    seen = nodes.select("id", F.explode("source_docs").alias("doc_id")).join(documents.select("doc_id", F.explode("countries").alias("country")), "doc_id")
    places = seen.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("country")), ",").alias("_c"))
    extra = F.when(F.col("_c").isNotNull(), F.create_map(F.lit("countries"), F.col("_c"))).otherwise(F.create_map().cast("map<string,string>"))
    kept = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, v: k != "countries")
    return nodes.join(places, "id", "left").withColumn("props", F.map_concat(kept, extra)).drop("_c")


def uploaded(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and jobs of uploaded files (path, content): what is known already isn't read again.

    A job (sha256, path, status) is ``cached`` for known content, ``empty`` or ``unsupported`` where there is
    nothing to read, else ``done``; uploaded documents are marked as such.
    """
    seen = sources.classify(files).withColumn("sha256", F.sha2("content", 256))
    old = seen.join(known.select("sha256"), "sha256", "left_semi").select("sha256", "path", F.lit("cached").alias("status"))
    new = seen.join(known.select("sha256"), "sha256", "left_anti")
    state_ = F.when(F.length("content") == 0, "empty").when(F.col("status") != "ok", "unsupported").otherwise("done")
    jobs = old.unionByName(new.select("sha256", "path", state_.alias("status")))
    readable = new.where((F.col("status") == "ok") & (F.length("content") > 0)).drop("sha256", "status")
    docs, chunks = documents(readable, known)
    return docs.withColumn("uploaded", F.lit(True)), chunks, jobs
