"""Secrets in texts: fixed patterns, and runs of signs that look drawn at random.

Method: a candidate is a whole run of ``[A-Za-z0-9+/_-]`` of 16 bytes or more with two kinds of signs at least (small,
capital, digit, other). Its encoding is the smallest alphabet that holds it. Three tests ask whether it can have been
drawn evenly from that alphabet: chi-squared of the signs' counts, runs of kinds, serial correlation of neighbours.
What passes all three is weighed against ordinary text: the corpus's own frequencies of signs and of changes between
kinds, in all its short runs, give the chance that ordinary text of that length repeats so few signs or changes its
kind so often. False discoveries are controlled (Benjamini-Hochberg) within each class of lengths, over all candidates.

Scale: one scan of the texts, which leaves a row of spans and a few numbers for each candidate; the corpus's
statistics are 130 sums, the chances a histogram of fixed size. Nothing is joined.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._memory import lean
from ._text import _LOW, chunks

KINDS = ("assign", "access", "hex", "random")
#: The patterns.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Every match of ASSIGN, in small letters, holds one of these.
_WORDS = re.compile(rb"passw(?:or)?d|secret|token|api_?key")

_DIGITS, _SMALL, _CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by name, the smaller alphabets first.
ENCODINGS = {
    "hex": _DIGITS + _SMALL[:6],
    "hex_capital": _DIGITS + _CAPITAL[:6],
    "base32": _CAPITAL + "234567",
    "base36": _DIGITS + _SMALL,
    "base36_capital": _DIGITS + _CAPITAL,
    "base62": _CAPITAL + _SMALL + _DIGITS,
    "base64": _CAPITAL + _SMALL + _DIGITS + "+/",
    "base64_url": _CAPITAL + _SMALL + _DIGITS + "-_",
}
CANDIDATE = 16
CLASSES = (20, 32, 64)
BINS, STEP = 1200, 20
_KIND = np.zeros(256, np.uint8)
for _k, _signs in enumerate((_SMALL, _CAPITAL, _DIGITS, "+/_-"), 1):
    _KIND[[ord(x) for x in _signs]] = _k
_HEX = np.zeros(256, bool)
_HEX[[ord(x) for x in ENCODINGS["hex"]]] = True
_PLACE = {k: np.array([a.find(chr(i)) for i in range(128)]) for k, a in ENCODINGS.items()}
_NAMES = tuple(ENCODINGS)
_SPAN = "struct<kind:string,start:long,end:long>"
_TOKEN = "struct<start:long,end:long,encoding:int,pairs:long,changes:long,serial:double>"
_COUNTS = 130


def _edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values; no run crosses a row."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    cut[[0, -1]] = True
    same = inside[1:] & inside[:-1] & ~cut[1:-1]
    starts = inside.copy()
    starts[1:] &= ~same
    ends = inside.copy()
    ends[:-1] &= ~same
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def measure(token: bytes) -> tuple[int, int, int, float] | None:
    """Encoding, pairs of equal signs, changes of kind and lag-1 serial correlation (circular); None if it has no encoding."""
    raw = np.frombuffer(token, np.uint8)
    kinds = _KIND[raw]
    if len(set(kinds.tolist())) < 2:
        return None
    for i, name in enumerate(_NAMES):
        at = _PLACE[name][raw]
        if at.min() >= 0:
            break
    else:
        return None
    counts = np.bincount(at)
    v = at.astype(float)
    spread = len(v) * (v @ v) - v.sum() ** 2
    serial = (len(v) * (v @ np.roll(v, -1)) - v.sum() ** 2) / spread if spread else 1.0
    return i, int((counts * (counts - 1) // 2).sum()), int((kinds[1:] != kinds[:-1]).sum()), float(serial)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The patterns' spans and the candidates of each text; a batch's counts of ordinary signs stand in its first row."""
    for b in batches:
        base: list[list | None] = [None] * len(b)
        tokens: list[list | None] = [None] * len(b)
        counts = np.zeros(_COUNTS, np.int64)
        for first, _, data, offsets in chunks(b.column(1)):
            if not len(data):
                continue
            found: dict[int, list[tuple[int, str, int]]] = {}
            runs: dict[int, list[tuple]] = {}
            row_of = lambda at: int(np.searchsorted(offsets, at, "right")) - 1  # noqa: B023, E731
            whole = data.tobytes()
            rows = {row_of(m.start()) for m in _WORDS.finditer(_LOW[data].tobytes())}
            for r in sorted(rows):
                for m in ASSIGN.finditer(whole[offsets[r] : offsets[r + 1]]):
                    if len(m[2]) >= LEAST["assign"]:
                        found.setdefault(r, []).append((m.start(), "assign", m.end()))
            at, rows = whole.find(b"AKIA"), set()
            while at >= 0:
                rows.add(row_of(at))
                at = whole.find(b"AKIA", at + 1)
            for r in sorted(rows):
                for m in ACCESS.finditer(whole[offsets[r] : offsets[r + 1]]):
                    if m.end() - m.start() >= LEAST["access"]:
                        found.setdefault(r, []).append((m.start(), "access", m.end()))
            starts, ends = _edges(_HEX[data], offsets)
            for i in np.flatnonzero(ends - starts >= LEAST["hex"]).tolist():
                r = row_of(starts[i])
                found.setdefault(r, []).append((int(starts[i] - offsets[r]), "hex", int(ends[i] - offsets[r])))
            kinds = _KIND[data]
            starts, ends = _edges(kinds > 0, offsets)
            counts[:128] += np.bincount(data[kinds > 0], minlength=128)[:128]
            inner = np.ones(len(data), bool)
            inner[starts] = False
            inner &= kinds > 0
            counts[128] += int(inner.sum())
            counts[129] += int((inner[1:] & (kinds[1:] != kinds[:-1])).sum())
            for i in np.flatnonzero(ends - starts >= CANDIDATE).tolist():
                token, own = whole[starts[i] : ends[i]], kinds[starts[i] : ends[i]]
                counts[:128] -= np.bincount(data[starts[i] : ends[i]], minlength=128)[:128]
                counts[128:] -= [len(own) - 1, int((own[1:] != own[:-1]).sum())]
                if seen := measure(token):
                    r = row_of(starts[i])
                    runs.setdefault(r, []).append((int(starts[i] - offsets[r]), int(ends[i] - offsets[r]), *seen))
            for r in {*found, *runs}:
                lead = (data[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80
                points = np.concatenate([[0], np.cumsum(lead)])
                base[first + r] = [{"kind": k, "start": int(points[x]), "end": int(points[y])} for x, k, y in sorted(found.get(r, []), key=lambda f: (f[0], KINDS.index(f[1])))] or None
                tokens[first + r] = [dict(zip(("start", "end", "encoding", "pairs", "changes", "serial"), (int(points[x]), int(points[y]), *rest), strict=True)) for x, y, *rest in runs.get(r, [])] or None
        if len(b):
            sums = [counts.tolist(), *[None] * (len(b) - 1)]
            yield pa.record_batch(
                [b.column(0), pa.array(base, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), pa.array(tokens, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.int32()), ("pairs", pa.int64()), ("changes", pa.int64()), ("serial", pa.float64())]))), pa.array(sums, pa.list_(pa.int64()))],
                ["doc_id", "base", "tokens", "counts"],
            )


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


class Judge:
    """The three tests, and how far from ordinary text a token is."""

    def __init__(self, counts: list[int], level: float):
        self.level = level
        self.change = (counts[129] + 1) / (counts[128] + 2)
        self.alphabets = []
        for signs in ENCODINGS.values():
            p = np.array([counts[ord(x)] + 1 for x in signs], float)
            p /= p.sum()
            share = np.bincount([int(_KIND[ord(x)]) for x in signs]) / len(signs)
            change, both = 1 - float((share**2).sum()), float((share * (1 - share) ** 2).sum())
            self.alphabets.append((len(signs), float((p**2).sum()), float((p**3).sum()), change, both))

    def random(self, n: int, encoding: int, pairs: int, changes: int, serial: float) -> bool:
        """Whether all three tests of an even draw from the encoding's alphabet pass."""
        a, _, _, change, both = self.alphabets[encoding]
        chi = a / n * (2 * pairs + n) - n
        # Wilson and Hilferty's cube root, with the variance that n signs have
        width = 2 / (9 * (a - 1))
        z = ((max(chi, 0) / (a - 1)) ** (1 / 3) - (1 - width)) / math.sqrt(width * (n - 1) / n)
        spread = (n - 1) * change * (1 - change) + 2 * (n - 2) * (both - change**2)
        y = max(abs(changes - (n - 1) * change) - 0.5, 0) / math.sqrt(spread)
        x = (serial + 1 / (n - 1)) / (n / (n - 1) / math.sqrt(n - 2))
        return min(_two_sided(z), _two_sided(y), _two_sided(x)) >= self.level / 3

    def chance(self, n: int, encoding: int, pairs: int, changes: int) -> float:
        """Decades by which the chance lies below 1 that ordinary text of this length has so few pairs or so many changes."""
        _, two, three, *_ = self.alphabets[encoding]
        mean = n * (n - 1) / 2 * two
        spread = n * (n - 1) / 2 * two * (1 - two) + n * (n - 1) * (n - 2) * max(three - two**2, 0)
        few = math.log10(max(0.5 * math.erfc((mean - pairs - 0.5) / math.sqrt(2 * spread)), 1e-300))
        rate, m, many = changes / (n - 1), n - 1, 0.0
        if rate > self.change:
            part = lambda x, y: x * math.log10(x / y) if x else 0.0
            many = -m * (part(rate, self.change) + part(1 - rate, 1 - self.change))
        return max(0.0, -min(few, many) - math.log10(2))

    def bin(self, token: dict) -> int:
        """Twentieths of a decade; 0 for what fails a test."""
        n, given = token["end"] - token["start"], [token[k] for k in ("encoding", "pairs", "changes")]
        if not self.random(n, *given, token["serial"]):
            return 0
        return min(BINS, int(STEP * self.chance(n, *given)))


def length_class(n: int) -> int:
    return sum(n >= x for x in CLASSES)


def thresholds(histogram: dict[tuple[int, int], int], rate: float) -> list[int]:
    """For each class of lengths the lowest bin to take so that at most ``rate`` of what is taken is false (none: beyond all bins)."""
    out = []
    for c in range(len(CLASSES) + 1):
        own = {b: n for (k, b), n in histogram.items() if k == c}
        total, taken, best = sum(own.values()), 0, BINS + 1
        for b in sorted(own, reverse=True):
            taken += own[b]
            if b and 10 ** (-b / STEP) * total <= rate * taken:
                best = b
        out.append(best)
    return out


def find_secrets(docs: DataFrame, rate: float = 0.01, level: float = 0.001) -> DataFrame:
    """The secrets of each text: doc_id, spans (kind, start, end; code points, end exclusive), by start and kind.

    ``docs``: doc_id, text; other columns are left out. One row for each row, in whatever order; a null or empty
    text has no spans; equal rows get equal spans. Kinds ``assign``, ``access`` and ``hex`` are the fixed patterns: leftmost
    matches without overlap, those too short are dropped. Kind ``random`` is what the tests find (it may lie on
    one of the others): of these at most a share ``rate`` is expected to be ordinary text, and one of 1 / ``level``
    random runs is missed. Runs of one kind of sign only (words, numbers) are not tested. Texts are read whole;
    memory is one text and a batch.
    """
    store = _store.Store(docs.sparkSession, "secrets")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = store.table(rows.mapInArrow(lean(_scan), f"doc_id long, base array<{_SPAN}>, tokens array<{_TOKEN}>, counts array<long>"), "scanned")
    sums = dict(scanned.where("counts IS NOT NULL").select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n")).collect())
    judge = Judge([sums.get(k, 0) for k in range(_COUNTS)], level)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(length_class(t["end"] - t["start"]), judge.bin(t)) for own in b.column(0).to_pylist() for t in own]
            yield pa.record_batch([pa.array([c for c, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int32())], ["class", "bin"])

    histogram = scanned.where("tokens IS NOT NULL").select("tokens").mapInArrow(binned, "class int, bin int").groupBy("class", "bin").count().collect()
    least = thresholds({(r["class"], r["bin"]): r["count"] for r in histogram}, rate)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for base, tokens in zip(b["base"].to_pylist(), b["tokens"].to_pylist(), strict=True):
                more = [{"kind": "random", "start": t["start"], "end": t["end"]} for t in tokens or [] if judge.bin(t) >= least[length_class(t["end"] - t["start"])]]
                out.append(sorted([*(base or []), *more], key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.record_batch([b["doc_id"], pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])

    return scanned.select("doc_id", "base", "tokens").mapInArrow(chosen, f"doc_id long, spans array<{_SPAN}>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the patterns' spans, and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("random"))
