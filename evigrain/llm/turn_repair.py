"""Structure repair of conversations: the cheapest edits after which the roles run system?, (user, assistant)+.

Method: a dynamic programme over the turns that stay. A turn stays as it is or with another role; between two
turns that stay, the turns left out are priced by prefix sums of deletions, and the pair of roles tells how
many turns must be put in. So for each role of the last turn that stays (or none yet) one running minimum is
enough. Of equal costs the smallest audit wins: the audits behind the running minima are never prefixes of
each other, so their order is kept as ranks, and a comparison takes no time.

Scale: the programme sees narrow rows (hashes and flags). They are dealt by range of (conversation, turn), so
a conversation of any length is spread over blocks. A block of a conversation that crosses a border is
reduced to costs and ranks from each entering to each leaving role; these are chained for each conversation
and the blocks traced back on their own. Texts meet the edits by key at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _store
from ._memory import lean

NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
FAR = 1 << 60
BLOCK = 400_000
#: A block is not made smaller than this to give every core one.
SMALL = 5_000
SALTS = 32
#: Turns to put in between the last turn that stays (first index) and the next one (second index), and at the end.
BETWEEN = ((0, 0, 0, 1), (FAR, FAR, 0, 1), (FAR, FAR, 1, 0), (FAR, FAR, 0, 1))
CLOSING = (0, 2, 1, 0)
_STATES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_SPACE = " \t\n\x0b\x0c\r"
_KEY = ("has", "c")
_ORDER = ("has", "c", "timed", "t", "role", "h")


def forward(turns: bytes, entry: int) -> tuple[list[int], list[int], list]:
    """Costs and ranks of the best audits by role of the last turn that stays, and the way back.

    A turn is 0 if it must go, else its role (4: another), plus 8 if it is cut short.
    """
    low, rank, gone, back = [FAR] * 4, [0, 1, 2, 3], 0, []
    low[entry] = 0
    for turn in turns:
        gone += DELETE
        if not turn:
            back.append(None)
            continue
        own, short = turn & 7, CUT_SHORT if turn & 8 else 0
        new, way = list(low), [None] * 4
        for to in (SYSTEM, USER, ASSISTANT):
            if to == SYSTEM and own != SYSTEM:
                continue
            at = min(range(4), key=lambda r: (low[r] + INSERT * BETWEEN[r][to], rank[r]))
            cost = low[at] + INSERT * BETWEEN[at][to] + (KEEP if own == to else REROLE) + short - DELETE
            if cost < low[to] or (cost == low[to] and at != to and rank[at] < rank[to]):
                new[to], way[to] = cost, (at, BETWEEN[at][to], "K" if own == to else "R")
        if any(way):
            # audits of different parents keep the parents' order; those of one parent differ in what is added
            keys = sorted(range(4), key=lambda r: (new[r] >= FAR // 2, rank[way[r][0]] if way[r] else rank[r], "I" * way[r][1] + way[r][2] if way[r] else "D"))
            rank = [keys.index(r) for r in range(4)]
            low = new
        back.append(way)
    return [x + gone if x < FAR // 2 else FAR for x in low], rank, back


def closed(low: list[int], rank: list[int]) -> int:
    """The role of the last turn that stays in the best audit of a whole conversation."""
    return min(range(4), key=lambda r: (low[r] + INSERT * CLOSING[r], rank[r]))


def _traced(turns: bytes, entry: int, leave: int | None) -> tuple[list[tuple[str, int, int]], int]:
    """For each turn its edit, the turns put in before it and its role; and the role left at the end."""
    low, rank, back = forward(turns, entry)
    at = closed(low, rank) if leave is None else leave
    out, last = [], at
    for way in reversed(back):
        if way is None or way[at] is None:
            out.append(("D", 0, NONE))
        else:
            before, put, edit = way[at]
            out.append((edit, put, at))
            at = before
    return out[::-1], last


_short = lru_cache(1 << 16)(_traced)


def traced(turns: bytes, entry: int = NONE, leave: int | None = None) -> tuple[list[tuple[str, int, int]], int]:
    return (_short if len(turns) <= 64 else _traced)(turns, entry, leave)


def chained(blocks: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """Entering and leaving role of each block, from the blocks' costs and ranks (4 x 4, by entering role)."""
    low, rank, ways = [0, FAR, FAR, FAR], [0, 1, 2, 3], []
    for cost, order in blocks:
        way = [min(range(4), key=lambda p: (low[p] + cost[4 * p + r], rank[p])) for r in range(4)]
        low = [min(low[way[r]] + cost[4 * way[r] + r], FAR) for r in range(4)]
        keys = sorted(range(4), key=lambda r: (low[r] >= FAR, rank[way[r]], order[4 * way[r] + r]))
        rank = [keys.index(r) for r in range(4)]
        ways.append(way)
    at, out = closed(low, rank), []
    for way in reversed(ways):
        out.append((way[at], at))
        at = way[at]
    return out[::-1]


def _codes(table: pa.Table) -> bytes:
    return bytes(table["code"].to_numpy().astype("uint8"))


def _summary(key: tuple, table: pa.Table) -> pa.Table:
    turns, cost, order = _codes(table.sort_by("pos")), [], []
    extra = DELETE * (sum(table["n"].to_pylist()) - len(table))
    for entry in range(4):
        low, rank, _ = forward(turns, entry)
        cost += [min(x + extra, FAR) for x in low]
        order += rank
    return pa.table({"has": [key[1].as_py()], "c": [key[2].as_py()], "pid": [key[0].as_py()], "cost": pa.array([cost], pa.list_(pa.int64())), "rank": pa.array([order], pa.list_(pa.int64()))})


def _chain(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("pid")
    found = chained(list(zip(table["cost"].to_pylist(), table["rank"].to_pylist(), strict=True)))
    last = len(found) - 1
    return pa.table({"has": table["has"], "c": table["c"], "pid": table["pid"], "entry": pa.array([p for p, _ in found], pa.int64()), "leave": pa.array([r for _, r in found], pa.int64()), "ends": pa.array([k == last for k in range(last + 1)], pa.bool_())})


_EDITS = "has boolean, c long, pid long, seq long, edit string, n long, initial string, fault string, timed boolean, t long, role string, h binary, state int"


def _edits(_: tuple, block: pa.Table, plan: pa.Table) -> pa.Table:
    block = block.sort_by("pos")
    known = {(a, b): (e, x, y) for a, b, e, x, y in zip(*(plan[k].to_pylist() for k in ("has", "c", "entry", "leave", "ends")), strict=True)}
    cols = {k: block[k].to_pylist() for k in ("has", "c", "pid", "n", "initial", "fault", "timed", "t", "role", "h")}
    codes, has, ids, n, fault = _codes(block), cols["has"], cols["c"], cols["n"], cols["fault"]
    rows, edits, counts, faults, states = [], [], [], [], []

    def add(i: int, edit: str, count: int, what: str | None, state: int) -> None:
        rows.append(i)
        edits.append(edit)
        counts.append(count)
        faults.append(what)
        states.append(state)

    at, m = 0, len(codes)
    while at < m:
        end = at + 1
        while end < m and ids[end] == ids[at] and has[end] == has[at]:
            end += 1
        entry, leave, ends = known.get((has[at], ids[at]), (NONE, None, True))
        found, last = traced(codes[at:end], entry, leave)
        for i, (edit, put, state) in enumerate(found, at):
            for k in range(put):
                add(i, "I", 1, None, USER if (state == ASSISTANT) == ((put - k) % 2 == 1) else ASSISTANT)
            add(i, edit, 1, fault[i], state)
            if n[i] > 1:
                add(i, "D", n[i] - 1, "blank" if fault[i] == "blank" else "duplicate", NONE)
        if ends:
            for k in range(CLOSING[last]):
                add(end - 1, "I", 1, None, ASSISTANT if CLOSING[last] - k == 1 else USER)
        at = end
    pick = lambda k, t: pa.array([cols[k][i] for i in rows], t)
    return pa.table(
        {
            "has": pick("has", pa.bool_()), "c": pick("c", pa.int64()), "pid": pick("pid", pa.int64()), "seq": pa.array(range(len(rows)), pa.int64()), "edit": pa.array(edits, pa.string()), "n": pa.array(counts, pa.int64()),
            "initial": pick("initial", pa.string()), "fault": pa.array(faults, pa.string()), "timed": pick("timed", pa.bool_()), "t": pick("t", pa.int64()), "role": pick("role", pa.string()), "h": pick("h", pa.binary()), "state": pa.array(states, pa.int32()),
        }
    )


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The edits of every conversation, in order of (block, seq): conv_id, block, seq, edit, n, turn, initial, fault, role, text.

    ``turns``: conv_id, turn, role, text; other columns are left out. A conversation's turns stand by turn (nulls
    first), ties by role and then by hash of the text; a null role or text is one space; rows with a null conv_id
    are one conversation. ``edit`` is K (keep), R (another role), D (delete; ``n`` rows at once) or I (an empty
    turn put in); ``role`` and ``text`` are those of the result, null for D; ``initial`` is the first letter of
    the role before. ``fault`` is the first of blank (nothing but ASCII white space), duplicate (role and text
    stood before) and truncated (the last sign isn't one of ``.!?``) that holds. Blank and duplicate turns go.
    Only roles that begin with s, u or a can be kept; a system turn only in front. No rows give no rows.

    Equal rows are counted, not carried. Memory: one block of narrow rows, and texts in Arrow batches, however
    long a conversation is; a single text is held whole.
    """
    spark = turns.sparkSession
    store = _store.Store(spark, "turn-repair")
    rows = turns.select(
        F.col("conv_id").isNotNull().alias("has"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c"), F.col("turn").isNotNull().alias("timed"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("t"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    rows = rows.withColumn("h", F.unhex(F.md5(F.concat_ws(":", F.octet_length("role"), F.col("role"), F.col("text")))))
    end = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    narrow = rows.select(*_ORDER, F.substring("role", 1, 1).alias("initial"), end.alias("_end"))
    narrow = narrow.groupBy(*_ORDER, "initial", (F.col("_end") == "").alias("blank"), (~F.col("_end").isin(".", "!", "?")).alias("short")).agg(F.count("*").alias("n"))
    narrow = store.table(narrow.withColumn("salt", F.pmod(F.xxhash64("timed", "t"), F.lit(SALTS)).cast("int")), "turns")
    # contents that stand at two turns or more, with the first: a hot content is dealt by salt
    alike = Window.partitionBy(*_KEY, "h")
    again = narrow.groupBy(*_KEY, "h", "salt").agg(F.min(F.struct("timed", "t")).alias("first"), F.count("*").alias("k"))
    again = again.withColumns({"first": F.min("first").over(alike), "k": F.sum("k").over(alike)}).where("k > 1").drop("k")
    flagged = narrow.join(again, [*_KEY, "h", "salt"], "left").withColumn("dup", F.coalesce(F.struct("timed", "t") > F.col("first"), F.lit(False)))
    fault = F.when(F.col("blank"), "blank").when(F.col("dup"), "duplicate").when(F.col("short"), "truncated")
    state = F.lit(4)
    for letter, value in _STATES.items():
        state = F.when(F.col("initial") == letter, value).otherwise(state)
    code = F.when(F.col("blank") | F.col("dup"), 0).otherwise(state + F.when(F.col("short"), 8).otherwise(0))
    flagged = flagged.select(*_ORDER, "initial", fault.alias("fault"), code.cast("int").alias("code"), "n")
    count = narrow.count()
    parts = _store.cut(count, block, min(spark.sparkContext.defaultParallelism, _store.cut(count, SMALL)))
    dealt = flagged.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    dealt = store.table(dealt.withColumns({"pid": F.spark_partition_id().cast("long"), "pos": F.monotonically_increasing_id()}), "blocks")
    # a border cuts one conversation at most: as many rows as there are blocks
    crossing = dealt.groupBy(*_KEY).agg(F.min("pid").alias("_lo"), F.max("pid").alias("_hi")).where("_lo < _hi").select(*_KEY)
    summary = dealt.join(F.broadcast(crossing), [*_KEY], "left_semi").groupBy("pid", *_KEY).applyInArrow(_summary, "has boolean, c long, pid long, cost array<long>, rank array<long>")
    plan = store.table(summary.groupBy(*_KEY).applyInArrow(_chain, "has boolean, c long, pid long, entry long, leave long, ends boolean"), "plan")
    edits = dealt.groupBy("pid").cogroup(plan.groupBy("pid")).applyInArrow(_edits, _EDITS)
    key = ["has", "c", "timed", "t", "h"]
    texts = rows.groupBy(*key).agg(F.first("text").alias("text"))
    out = edits.join(texts, key, "left")
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") != "D", F.element_at(F.array(*map(F.lit, ROLES)), F.col("state") + 1))
    text = F.when(F.col("edit").isin("K", "R"), F.col("text")).when(F.col("edit") == "I", "")
    return out.select(
        F.when(F.col("has"), F.col("c")).alias("conv_id"), F.col("pid").alias("block"), "seq", "edit", "n", F.when(F.col("timed"), F.col("t")).alias("turn"), F.when(F.col("edit") != "I", F.col("initial")).alias("initial"), "fault", role.alias("role"), text.alias("text")
    )


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_GOOD = {("s", "u"), ("u", "a"), ("a", "u")}


class _Digest:
    """What is told of one conversation, turn by turn."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.hash, self.lines, self.audit = conv_id, hashlib.sha256(), 0, []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.distinct = 0
        self.first = self.last = self.before = None

    def add(self, edit: str, n: int, turn: int | None, initial: str | None, fault: str | None, role: str | None, text: str | None) -> None:
        self.audit.append(edit * n)
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE * n, "I": INSERT}[edit]
        if edit != "D":
            self.hash.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode())
            self.lines += 1
            self.cost += CUT_SHORT * (fault == "truncated")
        if edit == "I":
            return
        if fault:
            self.faults[fault] += n
        if self.before is not None:
            self.illegal += (self.before, initial) not in _GOOD
        self.illegal += n - 1
        self.before = initial
        if turn is not None and (self.last is None or turn != self.last):
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def digest(edits: DataFrame) -> DataFrame:
    """One row for each conversation of :func:`repair`: faults, cost, audit and the hash of the repaired text.

    A hash of a whole text has to read it in order: a conversation passes through one task, as a sorted stream.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        names = [x.split(" ")[0] for x in _DIGEST.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2

        def flush() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return made

        for b in batches:
            for conv_id, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now:
                        done.append(now.row())
                    now = _Digest(conv_id)
                now.add(*rest)
            if done:
                yield flush()
        if now:
            done.append(now.row())
            yield flush()

    cols = edits.repartition("conv_id").sortWithinPartitions("conv_id", "block", "seq").select("conv_id", "edit", "n", "turn", "initial", "fault", "role", "text")
    return cols.mapInArrow(lean(stream), _DIGEST)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns damaged by crc32 of "conv_id:turn" modulo 20 (nulls: a space): 0 dropped, 1 emptied, 2 without ``.!?``, 3 twice, 4 by the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def report(turns: DataFrame) -> DataFrame:
    """:func:`digest` of the damaged turns, for every conversation there was; noughts for one that has lost all its turns."""
    told = digest(repair(damaged(turns)))
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    both = ids.alias("i").join(told.alias("d"), F.col("i.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    numbers = [F.coalesce(f"d.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("i.conv_id", *numbers, F.coalesce("d.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
