"""Incremental and stateful tables: manifests, caches, subscriptions, jobs, audit, access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What each role may do, and which documents it may see.
CAPABILITIES = {
    "researcher": ("search", "export"),
    "analyst": ("search", "export", "compare", "subscribe"),
    "manager": ("search", "dashboard", "export"),
    "partner": ("search",),
    "admin": ("search", "export", "compare", "subscribe", "dashboard", "edit", "audit"),
}
INTERNAL_SECTIONS = ("Обзоры", "Доклады")


def first_by_content(files: DataFrame) -> DataFrame:
    """One row for each content (sha256), the first by path, with the number of copies."""
    w = Window.partitionBy("sha256")
    return files.withColumns({"copies": F.count("*").over(w), "_k": F.row_number().over(w.orderBy("path"))}).where("_k = 1").drop("_k")


def numbered(df: DataFrame, key: str = "sha256", name: str = "doc_no", digits: int = 3) -> DataFrame:
    """Rows numbered from 1 in the order of a hash in hexadecimal, without a sort of all rows in one task.

    Rows are numbered within the groups of their first digits; the groups' sizes (at most 16 to the power of
    ``digits`` small rows) give where each group starts.
    """
    grouped = df.withColumn("_g", F.left(key, F.lit(digits)))
    before = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.groupBy("_g").agg(F.count("*").alias("_n")).select("_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    place = F.row_number().over(Window.partitionBy("_g").orderBy(key))
    return grouped.withColumn("_k", place).join(F.broadcast(starts), "_g").withColumn(name, F.col("_s") + F.col("_k")).drop("_g", "_k", "_s")


def new_ids(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """Contents (sha256) not yet known, numbered on from the largest known number: adds doc_no and doc_id."""
    new = fresh.join(known.select("sha256"), "sha256", "left_anti")
    start = known.agg(F.coalesce(F.max("doc_no"), F.lit(0)).alias("_m"))
    out = numbered(new).crossJoin(F.broadcast(start)).withColumn("doc_no", F.col("_m") + F.col("doc_no")).drop("_m")
    return out.withColumn("doc_id", F.format_string("d%06d", "doc_no"))


def sensitivity(given: Column, section: Column, internal: tuple[str, ...] = INTERNAL_SECTIONS) -> Column:
    """The given one, else by section."""
    return F.coalesce(given, F.when(section.isin(*internal), "internal").otherwise("public"))


def may_see(role: Column, level: Column) -> Column:
    """Outsiders see public documents only."""
    return (level == "public") | ~role.isin("partner", "external")


def cache_key(query: Column, filters: Column, role: Column, version: Column) -> Column:
    """A hash of the folded query, the filters as sorted JSON, the role and the data's version."""
    folded = F.lower(F.trim(F.regexp_replace(query, r"(?U)\s+", " ")))
    return F.sha2(F.concat_ws("|", folded, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(filters)))), role, version), 256)


def cache_lookup(asked: DataFrame, stored: DataFrame, at: str = "at") -> DataFrame:
    """Each request (k, at) with ``hit``: whether an entry of its key was made before and hasn't expired."""
    own = asked.select("request_id", "k", F.col(at).alias("_at"))
    live = own.join(stored.select("k", "created_at", "expires_at"), "k").where((F.col("created_at") < F.col("_at")) & (F.col("expires_at") >= F.col("_at")))
    hits = live.select("request_id").distinct().withColumn("hit", F.lit(True))
    return asked.join(hits, "request_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def newest(df: DataFrame, keep: int, order: str, tie: str) -> DataFrame:
    """The ``keep`` newest rows; nothing is sorted beyond them."""
    return df.orderBy(F.desc(order), F.desc(tie)).limit(keep)


def page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """A page of rows, newest first."""
    return df.orderBy(F.desc(order)).offset(offset).limit(limit)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; an aggregation, so it combines before the shuffle."""
    others = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return out.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def updates_since(items: DataFrame, cursors: DataFrame, key: str, at: str, cursor: str) -> DataFrame:
    """Items (key, at) newer than their subscription's cursor."""
    return items.join(cursors, key).where(F.col(at) > F.col(cursor))


#: The order in which sections are worked on, and errors of answers that were cut off.
SECTION_ORDER = ("Обзоры", "Статьи", "Доклады", "Журналы", "Материалы конференций")
CUT_OFF = ("json_parse", "schema_invalid")


def left_to_do(chunks: DataFrame, done: DataFrame, retry_only: bool = False, tokens: int = 3000, boosted: int = 8000) -> DataFrame:
    """Chunks (chunk_id, doc_id, seq, section) still to extract: adds failed, max_tokens and place.

    ``done``: chunk_id, ok, error. What succeeded is left out; what failed comes first, with more room where its
    answer was cut off; then by section, document and place. With ``retry_only`` nothing new is begun.
    ``place`` is the order; sort by it, or take parts of it.
    """
    last = done.groupBy("chunk_id").agg(F.max("ok").alias("_ok"), F.max(F.when(F.col("ok") == 0, F.col("error"))).alias("_error"))
    rows = chunks.join(last, "chunk_id", "left").where(F.coalesce("_ok", F.lit(0)) == 0)
    failed = F.col("_ok").isNotNull()
    cut = F.lit(False)
    for word in CUT_OFF:
        cut = cut | F.contains("_error", F.lit(word))
    order = F.coalesce(F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col("section")), F.lit(0))
    order = F.when(order > 0, order).otherwise(len(SECTION_ORDER) + 1).cast("int")
    rows = rows.withColumns({"failed": failed, "max_tokens": F.when(F.coalesce(cut, F.lit(False)), boosted).otherwise(tokens)})
    rows = rows.withColumn("place", F.struct((~failed).alias("fresh"), order.alias("section"), "doc_id", "seq")).drop("_ok", "_error")
    return rows.where("failed") if retry_only else rows


def recent_queries(history: DataFrame, keep: int = 25) -> DataFrame:
    """The ``keep`` latest distinct queries (up to case and white space) of each user (user_id, query, at), newest first."""
    folded = F.lower(F.trim(F.regexp_replace("query", r"(?U)\s+", " ")))
    last = history.groupBy("user_id", folded.alias("_q")).agg(F.max_by(F.struct("query", "at"), F.struct("at", "query")).alias("r")).select("user_id", "r.*")
    w = Window.partitionBy("user_id").orderBy(F.desc("at"), "query")
    return last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def cache_stats(requests: DataFrame, stored: DataFrame, size: str = "response") -> DataFrame:
    """One row: entries and their bytes, lookups, hits and the share of hits. ``requests`` as from :func:`cache_lookup`."""
    kept = stored.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length(size)), F.lit(0)).alias("bytes"))
    asked = requests.agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"))
    return kept.crossJoin(asked).withColumn("hit_rate", F.when(F.col("lookups") > 0, F.round(F.col("hits") / F.col("lookups"), 4)))


def counted(counters: DataFrame, events: DataFrame) -> DataFrame:
    """Counters (name, value) after events (name, delta); new names begin at their sum."""
    return counters.select("name", "value").unionByName(events.select("name", F.col("delta").alias("value"))).groupBy("name").agg(F.sum("value").alias("value"))


def subscribed(subscriptions: DataFrame, changes: DataFrame, key: str = "sub_id", order: tuple[str, ...] = ("at",)) -> DataFrame:
    """Subscriptions after changes (key, action ``put`` or ``delete``, order columns, fields): the last change of each counts.

    A new one starts with the cursor at the beginning of time, so that all there is counts as new.
    """
    fields = [c for c in subscriptions.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct("action", *[c for c in fields if c in changes.columns]), F.struct(*order)).alias("_r"))
    both = subscriptions.join(last, key, "full").where(F.col("_r").isNull() | (F.col("_r.action") != "delete"))
    new = {c: F.col(f"_r.{c}") if c in changes.columns else F.lit(None) for c in fields}
    start = {"cursor": F.to_timestamp(F.lit("1970-01-01 00:00:00"))} if "cursor" in fields else {}
    return both.select(key, *[F.coalesce(new[c], F.col(c), *([start[c]] if c in start else [])).alias(c) for c in fields])


def not_unique(table: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has, or that are null: key, n. Empty where the key is unique."""
    return table.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def to_embed(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """Chunks (chunk_id, text) without a vector of their present text in ``kept`` (chunk_id, sha256): adds sha256.

    So a run that stopped goes on where it was, and changed texts are embedded anew.
    """
    own = chunks.withColumn("sha256", F.sha2("text", 256))
    return own.join(kept.select("chunk_id", "sha256"), ["chunk_id", "sha256"], "left_anti")
