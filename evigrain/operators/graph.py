"""The property graph as two tables: building, merging, traversal, patterns, edits.

``nodes``: id, type, name, ...; ``edges``: edge_id, src, dst, type, .... Traversal is in
:mod:`evigrain.operators.reach`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EDGE_TYPES
from ..scratch import Steps


def edge_key(src: Column, kind: Column, dst: Column, *props: Column) -> Column:
    """An edge's id: ends, type and the properties that tell parallel edges apart."""
    return F.concat_ws("|", src, kind, dst, *[F.coalesce(p.cast("string"), F.lit("")) for p in props])


def canonical_props(props: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(props))))


def clean_edges(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges without self-loops and empty ends, unknown types as ``related``, one for each (src, dst, type, props).

    With ``tasks`` the edges are dealt to so many by their ends before they are grouped: for edges that seldom repeat, where
    grouping in each task first would only hold them.
    """
    known = F.when(F.col("type").isin(*EDGE_TYPES), F.col("type")).otherwise("related")
    ok = edges.where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).withColumn("type", known)
    others = [c for c in ok.columns if c not in ("src", "dst", "type")]
    ok = ok.repartition(tasks, "src", "dst", "type") if tasks else ok
    first = F.min_by(F.struct(*others), F.coalesce("edge_id", F.lit(""))).alias("_r")
    out = ok.groupBy("src", "dst", "type", canonical_props(F.col("props")).alias("_props")).agg(first)
    return out.select(*[F.col(c) if c in ("src", "dst", "type") else F.col(f"_r.{c}").alias(c) for c in ok.columns])


def memberships(nodes: DataFrame, column: str = "source_docs", name: str = "doc_id") -> DataFrame:
    """A list column of nodes as a table: id, ``name``, each pair once; nulls and empty lists have no row.

    A node that the whole corpus names has a row for each document here, where a list would be one row of any size.
    """
    return nodes.select("id", F.explode(column).alias(name)).where(F.col(name).isNotNull()).distinct()


def merge_nodes(nodes: DataFrame, order: str, apart: tuple[str, ...] = ()) -> DataFrame:
    """One row for each id: scalars of the row that came first, unions of lists, the highest confidence.

    Columns in ``apart`` are left out: lists that grow with the corpus belong in a table (:func:`memberships`).
    """
    nodes = nodes.drop(*apart)
    lists = [c for c, t in nodes.dtypes if t.startswith("array<string")]
    scalars = [c for c in nodes.columns if c not in ("id", "confidence", order, *lists)]
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    return nodes.groupBy("id").agg(*first, *union, F.max("confidence").alias("confidence"))


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those with the same key; the last change of a key wins."""
    if order:
        w = Window.partitionBy(key).orderBy(F.desc(order))
        changes = changes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return current.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def _override(old: Column, new: Column) -> Column:
    """Two maps as one, without nulls; ``new`` wins."""
    new = F.map_filter(new, lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(old, lambda k, v: v.isNotNull() & ~F.map_contains_key(new, k)), new)


def merge_fragment(current: DataFrame, fragment: DataFrame) -> DataFrame:
    """Existing nodes joined with a fragment's: the fragment's properties win, nulls are dropped, lists are united."""
    f = fragment.select(*[F.col(c).alias(f"_{c}") for c in fragment.columns])
    both = current.join(f, F.col("id") == F.col("_id"), "full_outer")
    empty = F.create_map().cast("map<string,string>")
    out = {}
    for c, t in current.dtypes:
        if t.startswith("map"):
            out[c] = _override(F.coalesce(c, empty), F.coalesce(f"_{c}", empty))
        elif t.startswith("array"):
            none = F.array().cast(t)
            out[c] = F.array_sort(F.array_union(F.coalesce(c, none), F.coalesce(f"_{c}", none)))
        elif c == "confidence":
            out[c] = F.greatest(c, f"_{c}")
        else:
            out[c] = F.coalesce(f"_{c}", c)
    return both.select(*[v.alias(k) for k, v in out.items()])


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways: a, b."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node, either way: id, degree."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame, few: bool = False) -> DataFrame:
    """Edges with both ends among ``nodes`` (id); if these are ``few`` the edges stay where they are."""
    ids = nodes.select("id").distinct()
    ids = F.broadcast(ids) if few else ids
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def overview(nodes: DataFrame, edges: DataFrame, limit: int, leaves: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` nodes of the highest degree, without ``leaves`` types, and the edges among them."""
    wide = nodes.where(~F.col("type").isin(*leaves)) if leaves else nodes
    anchors = wide.join(degrees(edges), "id").orderBy(F.desc("degree"), "id").limit(limit)
    return anchors, induced(edges, anchors, few=True)


def capped(subgraph: DataFrame, edges: DataFrame, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """A subgraph (id, anchor) cut to ``most`` nodes, anchors first, then by degree; and the edges left."""
    kept = subgraph.join(degrees(induced(edges, subgraph)), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    kept = kept.orderBy(F.desc(F.col("anchor").cast("int")), F.desc("degree"), "id").limit(most)
    return kept, induced(edges, kept, few=True)


def visible(nodes: DataFrame, edges: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A subgraph without blocked nodes (id) and their edges."""
    kept = nodes.join(blocked.select("id"), "id", "left_anti")
    return kept, induced(edges, kept)


def ranked_experts(works: DataFrame, limit: int) -> DataFrame:
    """Experts (expert, work) by distinct works, the most first."""
    return works.groupBy("expert").agg(F.countDistinct("work").alias("n_works")).orderBy(F.desc("n_works"), "expert").limit(limit)


#: Rows of a group that one task pairs with the whole group.
GROUP = 2000


def _spans(conditions: DataFrame) -> DataFrame:
    """Conditions as intervals: id, subject, param, lo, hi."""
    lo = F.when(F.col("op").isin("=", ">", ">=", "range"), F.col("value")).when(F.col("op") == "approx", F.col("value") - F.coalesce("value2", F.lit(0.0))).otherwise(float("-inf"))
    hi = F.when(F.col("op").isin("=", "<", "<="), F.col("value")).when(F.col("op") == "range", F.col("value2")).when(F.col("op") == "approx", F.col("value") + F.coalesce("value2", F.lit(0.0))).otherwise(float("inf"))
    return conditions.select("id", "subject", "param", lo.alias("lo"), hi.alias("hi"))


def contradictions(conditions: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Pairs of conditions on one (subject, param) whose values can't both hold: subject, param, a, b.

    ``conditions``: id, subject, param, op, value, value2. Each is an interval; two intervals that don't meet
    contradict each other. A pair comes once, the smaller id first. Only each subject's extreme intervals
    are compared at first: groups whose intervals share a point have no pair and never meet the join.
    """
    spans = _spans(conditions)
    groups = spans.groupBy("subject", "param").agg(F.max("lo").alias("_l"), F.min("hi").alias("_h"), F.count("*").alias("_k"))
    # a large group is dealt out in blocks, so that no task has all its pairs
    groups = groups.where(F.col("_l") > F.col("_h") + tolerance).select("subject", "param", F.ceil(F.col("_k") / GROUP).cast("int").alias("_blocks"))
    spans = spans.join(groups, ["subject", "param"])
    one = spans.withColumn("_block", F.pmod(F.xxhash64("id"), "_blocks").cast("int"))
    other = spans.select("subject", "param", F.col("id").alias("id2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    met = one.join(other, ["subject", "param", "_block"]).where((F.col("id") < F.col("id2")) & ((F.col("lo") > F.col("hi2") + tolerance) | (F.col("lo2") > F.col("hi") + tolerance)))
    return met.select("subject", "param", F.col("id").alias("a"), F.col("id2").alias("b"))


def opposed(conditions: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Conditions that others on one (subject, param) contradict, as :func:`contradictions` means it, without making pairs.

    Returns subject, param, id, n_opponents, below and above: the opponent that ends lowest and the one that begins
    highest (null where there is none on that side; ties to the smaller id). Conditions without a subject, a
    parameter or a value oppose nothing; a range whose ends are swapped is read in order. ``id`` must be unique,
    ``tolerance`` not negative.

    Opponents are counted by their places in one order of all ends. A group of any size is spread over many tasks:
    places are counted within each piece of the order, and on from the pieces before it.
    """
    lo, hi = F.least("lo", "hi"), F.greatest("lo", "hi")
    spans = _spans(conditions).where("subject IS NOT NULL AND param IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL").withColumns({"lo": lo, "hi": hi})

    def end(side: str, x: Column, order: int, point: int) -> Column:
        return F.struct("subject", "param", F.lit(side).alias("side"), x.alias("x"), F.lit(order).alias("o"), "id", F.lit(point).alias("point"))

    late = F.col("hi") + tolerance
    # above: beginnings after this end; below: ends before this beginning
    ends = spans.select(F.inline(F.array(end("above", F.col("lo"), 0, 1), end("above", late, 1, 0), end("below", F.col("lo"), 0, 0), end("below", late, 1, 1))))
    order = ["x", "o", "id"]
    group = ["subject", "param", "side"]
    steps = Steps(conditions.sparkSession, "opposed")
    ends = steps.write(ends.repartitionByRange(*group, *order).withColumn("piece", F.spark_partition_id()), "ends")
    pieces = ends.groupBy(*group, "piece").agg(F.sum("point").alias("n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    extremes = spans.groupBy("subject", "param").agg(F.min_by("id", F.struct("hi", "id")).alias("below"), F.min_by("id", F.struct(-F.col("lo"), "id")).alias("above"))
    pieces = pieces.withColumns({"start": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "all": F.sum("n").over(whole)}).drop("n").join(extremes, ["subject", "param"])
    own = Window.partitionBy(*group, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    asked = ends.withColumn("k", F.sum("point").over(own)).where("point = 0").join(pieces, [*group, "piece"])
    before = F.col("start") + F.col("k")
    n = F.when(F.col("side") == "above", F.col("all") - before).otherwise(before)
    there = {c: F.max(F.when((F.col("side") == c) & (F.col("n") > 0), F.col(c))).alias(c) for c in ("below", "above")}
    out = asked.withColumn("n", n).groupBy("subject", "param", "id").agg(F.sum("n").alias("n_opponents"), *there.values())
    return out.where("n_opponents > 0")


def revise(versions: DataFrame, edits: DataFrame, key: str = "edge_id", order: tuple[str, ...] = ("edited_at",)) -> DataFrame:
    """All versions of edited rows: each edit (key, order columns, new values) appends a row with the next version.

    A column an edit leaves null keeps its last value; edits of one moment follow the later order columns.
    """
    stamps = {c: F.lit(None).cast(t) for c, t in edits.dtypes if c in order}
    both = versions.withColumns({**stamps, "_first": F.lit(0)}).unionByName(edits.withColumn("_first", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_first", *order)
    carried = {c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in versions.columns if c != key}
    return both.withColumns({**carried, "version": F.row_number().over(w)}).drop("_first")


def current(versions: DataFrame, key: str = "edge_id") -> DataFrame:
    """The last version of each row."""
    w = Window.partitionBy(key).orderBy(F.desc("version"))
    return versions.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
