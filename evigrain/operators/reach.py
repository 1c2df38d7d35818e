"""Search from many nodes at once, with a bit for each source.

Up to 64 sources share one long: a node's state is a row for each word of sources that reach it, and a hop is one join
of the frontier with the edges and one aggregation by ``bit_or``. Each hop is written, so the plan of a hop is the
same for the tenth as for the first, and a hub costs a row a word however many paths lead to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Steps

WORD = 64
#: Frontiers of at most so many rows (of about 40 bytes) are broadcast: then the edges don't move.
SMALL = 500_000


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge as a step from either end: a, b. One scan; edges with a null end are left out."""
    ways = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.explode(ways).alias("e")).select("e.a", "e.b")


def bits_by_hop(edges: DataFrame, seeds: DataFrame, hops: int, small: int = SMALL, near: DataFrame | None = None) -> DataFrame:
    """Where sources arrive first: hop, id, word, bits (those that arrive at this hop and didn't before).

    ``seeds``: id, word, bits. Hop 0 is the seeds. It stops early where nothing is new. With ``near`` (id, left: how
    far from a target, each id once) a step is taken only to nodes from where a target is within the hops that remain.
    """
    steps = Steps(seeds.sparkSession, "reach")
    first = seeds.where("id IS NOT NULL").groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
    state = steps.write(first.select("id", "word", F.col("bits").alias("seen"), F.col("bits").alias("fresh")), "state0")
    out = [state.select(F.lit(0).alias("hop"), "id", "word", F.col("fresh").alias("bits"))]
    ways = both_ways(edges)
    if near is not None:
        ends = near.select(F.col("id").alias("b"), "left")
        ways = steps.write(ways.join(F.broadcast(ends) if ends.limit(small + 1).count() <= small else ends, "b"), "ways")
    for hop in range(1, hops + 1):
        frontier = state.where("fresh <> 0").select(F.col("id").alias("a"), "word", F.col("fresh").alias("bits"))
        count = frontier.count()
        if not count:
            break
        open_ways = ways if near is None else ways.where(F.col("left") <= hops - hop)
        met = open_ways.join(F.broadcast(frontier) if count <= small else frontier, "a")
        sent = met.select(F.col("b").alias("id"), "word", F.lit(0).cast("long").alias("seen"), "bits")
        held = state.select("id", "word", "seen", F.lit(0).cast("long").alias("bits"))
        merged = sent.unionByName(held).groupBy("id", "word").agg(F.bit_or("seen").alias("_seen"), F.bit_or("bits").alias("_sent"))
        fresh = F.col("_sent").bitwiseAND(F.bitwise_not("_seen"))
        state = steps.write(merged.select("id", "word", F.col("_seen").bitwiseOR(F.col("_sent")).alias("seen"), fresh.alias("fresh")), f"state{hop}")
        out.append(state.where("fresh <> 0").select(F.lit(hop).alias("hop"), "id", "word", F.col("fresh").alias("bits")))
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


def numbered(starts: DataFrame) -> DataFrame:
    """Distinct starts (start) with a word and a bit each, numbered in their order: start, word, bit.

    Words are filled from each task's own rows, so no task sees all starts: a task's last word may have room.
    """
    rows = Steps(starts.sparkSession, "starts").write(starts.where("start IS NOT NULL").select("start").distinct().withColumn("_task", F.spark_partition_id()), "rows")
    place = F.row_number().over(Window.partitionBy("_task").orderBy("start")) - 1
    at = rows.withColumn("_at", place)
    word = F.col("_task").cast("long") * (1 << 40) + F.floor(F.col("_at") / WORD)
    return at.select("start", word.alias("word"), (F.col("_at") % WORD).cast("int").alias("bit"))


def _bit(column: str) -> Column:
    return F.expr(f"shiftleft(1L, {column})")


def within_hops(edges: DataFrame, starts: DataFrame, hops: int, targets: DataFrame | None = None) -> DataFrame:
    """Nodes within ``hops`` steps of each start (start), whatever the edges' direction: start, id, distance.

    A start is at distance 0 from itself, whether it has edges or not; a repeated start counts once. A node
    comes once for each start, at its smallest distance. With ``targets`` (id) only these are sought: how far nodes are
    from any target is searched first, in one word for all, and no start goes where none is within what remains of its hops.
    """
    steps = Steps(starts.sparkSession, "numbers")
    known = steps.write(numbered(starts), "rows")
    near = None
    if targets is not None:
        targets = steps.write(targets.where("id IS NOT NULL").select("id").distinct(), "targets")
        edges = steps.write(edges.select("src", "dst"), "edges")
        one = F.lit(0).cast("long").alias("word"), F.lit(1).cast("long").alias("bits")
        near = steps.write(bits_by_hop(edges, targets.select("id", *one), hops - 1).select("id", F.col("hop").alias("left")), "near")
    found = bits_by_hop(edges, known.select(F.col("start").alias("id"), "word", _bit("bit").alias("bits")), hops, near=near)
    if targets is not None:
        found = found.join(targets, "id", "left_semi")
    single = found.select("hop", "id", "word", F.explode(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.getbit("bits", k) == 1)).alias("bit"))
    return single.join(known, ["word", "bit"]).select("start", "id", F.col("hop").alias("distance"))


def near_kinds(edges: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """For nodes within ``hops`` of any target (id, kind: 0 to 63), which kinds: id, kinds (bits). Searched from the targets."""
    seeds = targets.select("id", F.lit(0).cast("long").alias("word"), _bit("kind").alias("bits"))
    return bits_by_hop(edges, seeds, hops).groupBy("id").agg(F.bit_or("bits").alias("kinds"))


def without(left: DataFrame, edges: DataFrame, hops: int, targets: DataFrame) -> DataFrame:
    """Rows of ``left`` (id) with none of ``targets`` (id) within ``hops`` steps; a target is near itself."""
    near = near_kinds(edges, targets.select("id", F.lit(0).alias("kind")), hops)
    return left.join(near.select("id"), "id", "left_anti")


def unevidenced(nodes: DataFrame, edges: DataFrame, pair_types: tuple[str, ...], evidence: tuple[str, ...], left: str, right: str, hops: int = 2) -> DataFrame:
    """Pairs of a ``left`` and a ``right`` node on an edge of ``pair_types``, the left one with no ``evidence`` type near: left, right."""
    targets = nodes.where(F.col("type").isin(*evidence)).select("id", F.lit(0).alias("kind"))
    kinds = nodes.select("id", "type")
    ways = both_ways(edges.where(F.col("type").isin(*pair_types)))
    lone = without(nodes.where(F.col("type") == left).select("id"), edges, hops, targets)
    pairs = ways.join(lone.select(F.col("id").alias("a")), "a", "left_semi")
    ends = kinds.where(F.col("type") == right).select(F.col("id").alias("b"))
    return pairs.join(ends, "b", "left_semi").select(F.col("a").alias("left"), F.col("b").alias("right")).distinct()


def linked_documents(entities: DataFrame, edges: DataFrame, publications: DataFrame, hops: int = 2) -> DataFrame:
    """Documents of each entity (id, docs): its own and those of publications (id, doc_id) within ``hops`` (at most 3): id, doc_id."""
    near = within_hops(edges, entities.select(F.col("id").alias("start")), min(max(hops, 1), 3), publications.select("id")).where("distance > 0")
    found = near.join(publications.select("id", "doc_id"), "id").select(F.col("start").alias("id"), "doc_id")
    own = entities.select("id", F.explode("docs").alias("doc_id"))
    return found.unionByName(own).where("id IS NOT NULL AND doc_id IS NOT NULL").distinct()


def nearest(edges: DataFrame, starts: DataFrame, targets: DataFrame, hops: int, limit: int, small: int = SMALL) -> DataFrame:
    """Of each start (id) the ``limit`` targets (id) nearest within ``hops``, whatever the edges' direction: id, target, distance.

    By distance and then by id; a start that is a target is its own at distance 0. Lists of so many targets go from the
    targets along the edges: what is among a node's nearest is among those of the neighbour before it, so a node never
    holds or sends more, and pairs of starts and targets beyond the list are never made. A task's rows of a node are cut to the nearest before they move.
    """
    steps = Steps(starts.sparkSession, "nearest")
    few = lambda df: F.broadcast(df) if df.limit(small + 1).count() <= small else df
    starts = few(steps.write(starts.where("id IS NOT NULL").select("id").distinct(), "starts"))
    ways = both_ways(steps.write(edges.select("src", "dst"), "edges"))
    found = steps.write(targets.where("id IS NOT NULL").select("id").distinct(), "targets").select("id", F.col("id").alias("target"), F.lit(0).alias("distance"))
    for hop in range(1, hops + 1):
        own, steps_on = found, ways
        if hop == hops:  # only the starts' lists are wanted
            own, steps_on = found.join(starts, "id", "left_semi"), ways.join(starts.select(F.col("id").alias("b")), "b", "left_semi")
        sent = steps_on.join(few(found.withColumnRenamed("id", "a")), "a").select(F.col("b").alias("id"), "target", (F.col("distance") + 1).alias("distance"))
        by = Window.partitionBy("id").orderBy("distance", "target")
        # a target comes at up to hop + 1 distances; equal rows share a rank
        near = sent.unionByName(own).withColumn("_k", F.dense_rank().over(by)).where(F.col("_k") <= (hop + 1) * limit)
        near = near.groupBy("id", "target").agg(F.min("distance").alias("distance"))
        found = steps.write(near.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= limit).drop("_k"), f"near{hop}")
    return found


def linked_assertions(entities: DataFrame, edges: DataFrame, assertions: DataFrame, limit: int = 12) -> DataFrame:
    """Assertions (id) within two hops of each entity (id), the nearest first and then by id, ``limit`` at most: entity, id, distance."""
    near = nearest(edges, entities, assertions, 2, limit + 1).where("distance > 0")  # one more: an entity may be an assertion
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "target"))
    return near.withColumn("_k", place).where(F.col("_k") <= limit).select(F.col("id").alias("entity"), F.col("target").alias("id"), "distance")
