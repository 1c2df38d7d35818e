"""Plain-Python versions of operators, for comparison on small tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict


def fold(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def discounts(counts) -> list[float]:
    n = Counter(counts)
    n1, n2, n3, n4 = (n[k] for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return [0.0, *(min(max(x, 0.01), k - 0.01) for k, x in enumerate(d, 1))]


def kneser_ney(docs: list[tuple[int, str | None]], repeated: bool = False) -> list[tuple]:
    """Rows of op2: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    streams = {i: [*words(t), None] for i, t in docs}
    uni, bi = Counter(), Counter()
    for i, s in [(i, streams[i]) for i, _ in docs] if repeated else streams.items():
        if fold(i, 10):
            uni.update(s)
            bi.update(zip(["<s>", *s[:-1]], s, strict=True))
    total, vocabulary = sum(uni.values()), len(uni)
    left, after, ctx = Counter(w for _, w in bi), defaultdict(list), Counter()
    for (u, _), c in bi.items():
        after[u].append(c)
        ctx[u] += c
    d2, d1 = discounts(bi.values()), discounts(left.values())
    pairs = len(bi)
    gamma = {u: sum(d2[min(c, 3)] for c in cs) / ctx[u] for u, cs in after.items()}
    spare = sum(d1[min(c, 3)] for c in left.values()) / pairs if pairs else 1.0
    out = []
    for i, s in streams.items():
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (vocabulary + 1))) for w in s)
        score = 0.0
        for u, w in zip(["<s>", *s[:-1]], s, strict=True):
            low = (left[w] - d1[min(left[w], 3)]) / max(pairs, 1) + spare / (vocabulary + 1)
            c = bi[u, w]
            score += math.log10((c - d2[min(c, 3)]) / ctx[u] + gamma[u] * low if u in ctx else low)
        out.append((i, fold(i, 10) == 0, len(s), sum(uni[w] > 0 for w in s), total, base, score))
    return out


def components(docs: list[tuple[int, str | None]], width: int, percent: int = 80) -> list[tuple]:
    """Rows of op4: doc_id, n_shingles, component_id, kept."""
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = len(sets[a]), len(sets[b])
            if 100 * min(x, y) >= percent * max(x, y):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (x + y - both):
                    u, v = find(a), find(b)
                    parent[max(u, v)] = min(u, v)
    return [(i, len(s), find(i), find(i) == i) for i, s in sets.items()]
