"""The trie and the repair of conversations against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
import pytest

from evigrain.llm import prefix_trie, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, block long, n string, key string, h int"
EMPTY = hashlib.sha256().hexdigest()


def plain_trie(sequences: dict[int, list[tuple[str, int]]]) -> set[tuple]:
    """Nodes of sequences of (turn, words)."""
    members, ends, words = defaultdict(list), defaultdict(list), {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            node = tuple(x for x, _ in s[:d])
            members[node].append(c)
            words[node] = s[d - 1][1] if d else 0
        ends[tuple(x for x, _ in s)].append(c)
    out = set()
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * words[x] for x in below)
        parent = min(members[node[:-1]]) if node else None
        out.add((min(own), len(node), parent, len(own), len(kids), len(leaves), saved, hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return out


def in_blocks(sequences: dict[int, list[tuple[str, int]]], cuts: list[int]) -> set[tuple]:
    """The operator's steps over blocks that end at ``cuts``, without Spark."""
    rows = sorted((b"".join(hashlib.md5(x.encode()).digest() for x, _ in s), c, [w for _, w in s]) for c, s in sequences.items())
    edges = [0, *cuts, len(rows)]
    blocks = {7 + 2 * i: rows[a:b] for i, (a, b) in enumerate(itertools.pairwise(edges)) if b > a}
    kinds = {"pid": pa.int64(), "pos": pa.int64(), "conv_id": pa.int64(), "key": pa.binary(), "words": pa.list_(pa.int32())}
    tables = {p: pa.table({"pid": [p] * len(x), "pos": range(len(x)), "conv_id": [r[1] for r in x], "key": [r[0] for r in x], "words": [r[2] for r in x]}, schema=pa.schema(kinds)) for p, x in blocks.items()}
    measured = [prefix_trie._measured((pa.scalar(p),), t).to_pylist()[0] for p, t in tables.items()]
    before = [None, *[m["last"] for m in measured[:-1]]]
    batch = pa.record_batch({"pid": [m["pid"] for m in measured], "first": [m["first"] for m in measured], "before": pa.array(before, pa.binary()), "inner": [m["inner"] for m in measured]})
    skeleton = prefix_trie.Skeleton([tuple(r.values()) for b in prefix_trie._borders(iter([batch])) for r in b.to_pylist()])
    parts = [r for p, t in tables.items() for r in prefix_trie._partials(skeleton)((pa.scalar(p),), t).to_pylist()]
    merged, ids = {}, defaultdict(list)
    for r in parts:
        m = merged.setdefault((r["first"], r["depth"]), {"low": r["low"], **dict.fromkeys(prefix_trie._SUMS, 0)})
        m["low"] = min(m["low"], r["low"])
        for k in prefix_trie._SUMS:
            m[k] += r[k]
        if r["ids"] is not None:
            ids[r["first"], r["depth"]].append((r["pid"], r["part"], r["ids"]))
    pieces = [(*k, t) for k in sorted(ids) for _, _, t in sorted(ids[k])]
    batches = [pa.record_batch({"first": [x[0] for x in some], "depth": [x[1] for x in some], "ids": [x[2] for x in some]}) for some in (pieces[i : i + 2] for i in range(0, len(pieces), 2))]
    hashes = {(r["first"], r["depth"]): r["sha"] for b in prefix_trie._hashes(iter(batches)) for r in b.to_pylist()}
    out = []
    names = ("first", "depth", "low", *prefix_trie._SUMS)
    for p, t in tables.items():
        own = [{"first": f, "depth": d, **merged[f, d], "sha": hashes.get((f, d))} for f, d in {(r["first"], r["depth"]) for r in parts if r["pid"] == p}]
        back = pa.table({**{k: pa.array([r[k] for r in own], pa.int64()) for k in names}, "sha": pa.array([r["sha"] for r in own], pa.string())})
        out += [tuple(r.values()) for r in prefix_trie._nodes(skeleton)((pa.scalar(p),), t, back).to_pylist()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("seed", range(150))
def test_trie_is_the_same_in_any_blocks(seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(prefix_trie, "CHUNK", rnd.choice([1, 2, 1024]))
    words = {x: rnd.randint(0, 5) for x in "abc"}
    base = [[(x, words[x]) for x in rnd.choices("abc", k=rnd.randint(0, 6))] for _ in range(4)]
    sequences = {}
    for c in rnd.sample(range(-20, 80), rnd.randint(1, 24)):
        s = rnd.choice(base)[: rnd.randint(0, 6)] if rnd.random() < 0.7 else []
        sequences[c] = s + [(x, words[x]) for x in rnd.choices("abc", k=rnd.choice([0, 0, 1, 2]))]
    n = len(sequences)
    cuts = sorted(rnd.choices(range(n + 1), k=rnd.choice([0, 1, 2, 5, n])))
    assert in_blocks(sequences, cuts) == plain_trie(sequences)


def plain_rebuilt(rows: list[tuple]) -> dict[int, list[tuple[str, int]]]:
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        lent = sorted(turns.get(c - c % 20, []))[:h]
        out[c] = [(f"{role}\0{text}", len(text.encode().split())) for _, _, role, text in lent + sorted(own)[h:]]
    return out


def conversations(seed: int = 3) -> list[tuple]:
    rnd = random.Random(seed)
    texts = ["Hello there.", "What is it?", "no end", "", " \t\n", "a.b", "Yes!", "é…", "line\nline.", "x" * 5000 + "."]
    rows = []
    for c in range(70):
        for t in range(rnd.choice([1, 2, 3, 5, 9])):
            rows.append((c, t if rnd.random() < 0.95 else t + 3, rnd.choice(["user", "assistant", "assistant", "system", "tool", "", "usher"]), rnd.choice(texts) if rnd.random() < 0.6 else f"text {c % 3} {t}."))
    rows += [(40, None, None, None), (200, 1, "user", "a."), (200, 1, "user", "a."), (201, None, "assistant", None), (219, 0, "user", "lent."), (200, 5, None, "x.")]
    rows += [(300, k, ("assistant", "user")[rnd.random() < 0.5], f"turn {rnd.choice([k, 1])}" + "." * (k % 3)) for k in range(400)]
    return [(*r, 1, "x", "k", 2) for r in rows]


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "SMALL", block)
    rows = conversations()
    turns = spark.createDataFrame([*rows, (None, 1, "user", "left out.", 1, "x", "k", 2)], SCHEMA).repartition(3)
    got = prefix_trie.trie(prefix_trie.rebuilt(turns), block).collect()
    assert len(got) == len({(r.conv_id, r.depth) for r in got})
    assert {tuple(r) for r in got} == plain_trie(plain_rebuilt(rows))


def test_trie_of_copies_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SMALL", 100)
    rows = [(20 * c, t, "user", f"same {t}") for c in range(300) for t in range(4)] + [(20 * c, 0, "user", f"own {c}") for c in range(300, 320)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(made), 100).collect()} == plain_trie(plain_rebuilt(rows))
    assert prefix_trie.trie(prefix_trie.rebuilt(made.limit(0))).count() == 0
    lone = [tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([(1, 0, "user", "one")], made.schema))).collect()]
    assert set(lone) == plain_trie(plain_rebuilt([(1, 0, "user", "one")]))


def brute_audit(turns: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """The cheapest and then smallest audit of (initial, gone, short) turns: every state, every edit."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i: int, last: str, put: int) -> tuple[int, str]:
        found = []
        if i == len(turns) and last in ("", "a"):
            found.append((0, ""))
        if i < len(turns):
            initial, gone, short = turns[i]
            found.append((lambda x: (x[0] + 2, "D" + x[1]))(best(i + 1, last, 0)))
            if not gone:
                for to in follow[last]:
                    if initial == to:
                        found.append((lambda x: (x[0] + 5 * short, "K" + x[1]))(best(i + 1, to, 0)))
                    if to != "s":
                        found.append((lambda x: (x[0] + 1 + 5 * short, "R" + x[1]))(best(i + 1, to, 0)))
        if put < 3:
            for to in follow[last]:
                if to != "s":
                    found.append((lambda x: (x[0] + 5, "I" + x[1]))(best(i, to, put + 1)))
        return min(found) if found else (10**9, "")

    return best(0, "", 0)


@pytest.mark.parametrize("seed", range(300))
def test_audits(seed):
    rnd = random.Random(seed)
    turns = [(rnd.choice("ssuuaax"), rnd.random() < 0.2, rnd.random() < 0.2) for _ in range(rnd.randint(0, 12))]
    codes = bytes(0 if gone else {"s": 1, "u": 2, "a": 3, "x": 4}[i] + 8 * short for i, gone, short in turns)
    found, last = turn_repair.traced(codes)
    audit = "".join("I" * put + e for e, put, _ in found) + "I" * turn_repair.CLOSING[last]
    cost, want = brute_audit(turns)
    assert audit == want
    low, rank, _ = turn_repair.forward(codes, 0)
    at = turn_repair.closed(low, rank)
    assert low[at] + 5 * turn_repair.CLOSING[at] == cost
    # the same through blocks
    edges = sorted(rnd.choices(range(len(codes) + 1), k=3))
    blocks = [codes[a:b] for a, b in itertools.pairwise([0, *edges, len(codes)])]
    summaries = [tuple(sum(x, []) for x in zip(*[turn_repair.forward(b, e)[:2] for e in range(4)], strict=True)) for b in blocks]
    ways = turn_repair.chained(summaries)
    parts = [turn_repair.traced(b, *w)[0] for b, w in zip(blocks, ways, strict=True)]
    assert "".join("I" * put + e for p in parts for e, put, _ in p) + "I" * turn_repair.CLOSING[ways[-1][1]] == want


def plain_report(rows: list[tuple]) -> set[tuple]:
    kept, ids = defaultdict(list), {r[0] for r in rows}
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        if kind:
            kept[c] += [(t is not None, t or 0, "user" if kind == 4 else role, hashlib.md5(f"{len(('user' if kind == 4 else role).encode())}:{'user' if kind == 4 else role}:{text}".encode()).digest(), text)] * (2 if kind == 3 else 1)
    out = set()
    for c in ids:
        own, seen, turns, counts = sorted(kept[c]), set(), [], [0, 0, 0]
        for _, _, role, _, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            turns.append((role[:1], fault in (0, 1), fault == 2))
        cost, audit = brute_audit(turns)
        lines, i, last = [], 0, ""
        for e in audit:
            if e != "I":
                i += 1
            if e != "D":
                role = own[i - 1][2] if e == "K" else "assistant" if last == "u" else "user"
                lines.append(f"{role}:{'' if e == 'I' else own[i - 1][4]}")
                last = role[0]
        times = {t for timed, t, *_ in own if timed}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out.add((c, max(times) - min(times) + 1 - len(times) if times else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("small", [30, 1 << 20])
def test_repair(spark, monkeypatch, small):
    monkeypatch.setattr(turn_repair, "SMALL", small)
    monkeypatch.setattr(turn_repair, "BLOCK", small)
    import sys

    sys.setrecursionlimit(20_000)
    rows = [*conversations(), (None, 1, "user", "no id.", 1, "x", "k", 2), (None, None, "assistant", "cut", 1, "x", "k", 2)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {tuple(r) for r in turn_repair.report(turns).collect()}
    assert got == plain_report(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be good."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "Out."), (1, 4, "user", "And?")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(r.edit, r.n, r.fault, r.role, r.text) for r in turn_repair.repair(turns).orderBy("block", "seq").collect()]
    assert got == [("K", 1, None, "system", "Be good."), ("K", 1, None, "user", "Hi."), ("D", 1, "duplicate", None, None), ("D", 1, None, None, None), ("R", 1, None, "assistant", "And?")]
    assert turn_repair.report(turns.limit(0)).count() == 0 and turn_repair.repair(turns.limit(0)).count() == 0
