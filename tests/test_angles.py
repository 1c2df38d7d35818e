"""The threshold join of vectors against every pair."""

from __future__ import annotations

import numpy as np
import pytest

from evigrain.operators import angles

SCHEMA = "id long, v array<double>, found long, cell int"


def plain(left, right, least, other):
    unit = lambda v: np.array(v) / np.sqrt((np.array(v) ** 2).sum())
    out = {}
    for i, v in left:
        best = max(((round(float(unit(v) @ unit(w)), 10), -j) for j, w in right if not (other and i == j)), default=(-9, 0))
        if best[0] >= least:
            out[i] = -best[1]
    return out


@pytest.mark.parametrize(("least", "rows", "other"), [(0.83, 4096, False), (0.83, 50, True), (0.5, 64, False), (-1.0, 4096, True), (0.999, 4096, False)])
def test_nearest_is_that_of_all_pairs(spark, monkeypatch, least, rows, other):
    monkeypatch.setattr(angles, "ROWS", rows)
    rng = np.random.default_rng(int(1000 * (least + 2)))
    centres = rng.normal(size=(12, 8))
    make = lambda n, first: [(first + i, (centres[rng.integers(12)] * rng.uniform(0.1, 9) + rng.normal(size=8) * rng.choice([0.05, 0.3, 1])).tolist()) for i in range(n)]
    right = make(400, 0)
    left = right[:150] + make(150, 1000) if other else make(300, 1000)
    same = [(2000 + i, right[3][1]) for i in range(60)]  # a group of copies
    right, left = right + same, left + same[:30]
    odd = [(None, [1.0] * 8), (5000, None), (5001, [0.0] * 8), (5002, [1.0] * 7), (5003, []), (5004, [float("nan")] * 8), (5005, [1.0] * 7 + [None])]
    frame = lambda x: spark.createDataFrame([(i, v, 9, 7) for i, v in x + odd], SCHEMA).repartition(3)
    got = angles.nearest_within(frame(left), frame(right), least, other=other).collect()
    assert {r.id: r.found for r in got} == plain(left, right, least, other)
    assert len(got) == len({r.id for r in got})


def test_few_pairs_are_compared_where_vectors_cluster(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 32))
    vectors = [(i, (centres[i % 200] + rng.normal(size=32) * 0.1).tolist(), 0, 0) for i in range(4000)]
    table = spark.createDataFrame(vectors, SCHEMA)
    got = angles.nearest_within(table, table, 0.83, other=True).collect()
    assert len(got) == 4000 and all(r.id % 200 == r.found % 200 for r in got)
    assert sum(r.compared for r in got) < 0.1 * 4000 * 4000


def test_vectors_without_structure_are_not_copied_to_every_cell(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=48).tolist()) for i in range(300)]
    table = spark.createDataFrame([(i, v, 0, 0) for i, v in vectors], SCHEMA)
    written, write = [], angles.Steps.write
    monkeypatch.setattr(angles.Steps, "write", lambda *a: written.append(write(*a)) or written[-1])
    got = angles.nearest_within(table, table, 0.3, other=True).collect()
    assert {r.id: r.found for r in got} == plain(vectors, vectors, 0.3, True)
    assert sum(w.count() for w in written) <= 2 * len(vectors)


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0, 0.0], 0, 0)], SCHEMA)
    assert angles.nearest_within(none, some, 0.5).count() == angles.nearest_within(some, none, 0.5).count() == 0
    assert [tuple(r)[:2] for r in angles.nearest_within(some, some, 0.5).collect()] == [(1, 1)]
    assert angles.nearest_within(some, some, 0.5, other=True).count() == 0
