"""The written index against BM25 over all documents."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigrain.operators import postings, ranking


def best(found, k):
    rows = ranking.top(found.withColumn("score", F.round("score", 6)), k, [F.desc("score"), F.asc("doc_id")], ["query_id"])
    return sorted((r.query_id, r.rank, r.doc_id, r.n_terms, r.score) for r in rows.collect())


def searched(spark, folder, queries, k):
    found = postings.Search(spark, folder, queries, k)
    return sorted((r.query_id, r.rank, r.doc_id, r.n_terms, r.score) for r in found.results.collect()), {r.query_id: (r.blocks, r.read) for r in found.read.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(1500):
        # words of a theme lie together, as they do in a corpus read by source
        theme = [f"t{i // 150}w{k}" for k in range(20)]
        words = rnd.choices(["the", "of", "und", "é", "x1"], k=rnd.randint(0, 30)) + rnd.choices(theme, k=rnd.randint(0, 10)) + rnd.choices([f"r{k}" for k in range(200)], k=3)
        rnd.shuffle(words)
        rows.append((i * 7 - 2000, " ".join(words)))
    rows += [(10**12, None), (-(10**12), ""), (10**15, "the " * 5000), (5, "The THE the, t3w1!")]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "the of"), (2, "t3w1 t3w2 the"), (3, "r7"), (4, "nothing here"), (5, ""), (6, None), (7, "r1 r2 r3 t9w0 und")], "query_id long, query string")


def test_packed_numbers():
    for values in ([], [0], [255], [256, 1], [2**32, 3], [2**40]):
        assert postings.unpacked(postings.packed(np.array(values, np.uint64))).tolist() == values
    for docs in ([5], [-3, 0, 2**50], list(range(100))):
        assert postings.numbers(postings.deltas(np.array(docs, np.int64))).tolist() == docs
    tf, n = np.array([3, 1, 3, 2, 1]), np.array([9, 4, 7, 8, 5])
    assert postings.peaks(tf, n) == [{"tf": 3, "length": 7}, {"tf": 1, "length": 4}]


def test_blocks_of_a_window_are_made_at_once(monkeypatch):
    rnd = random.Random(9)
    texts = [rnd.choices(["the", "é", *(f"w{k}" for k in range(60))], k=rnd.choice([0, 1, 5, 40, 300])) for _ in range(50)]
    ids = rnd.sample([*range(-(2**62), 2**62, 2**56), *range(40)], 50)
    want = []
    for lo in range(0, 50, 8):
        found = {}
        for i, terms in sorted(zip(ids[lo : lo + 8], texts[lo : lo + 8], strict=True)):
            for term in {"", *terms}:
                found.setdefault(term, []).append((i, terms.count(term) or 1, len(terms)))
        for term, rows in found.items():
            doc, tf, length = map(np.array, zip(*rows, strict=True))
            want.append((term, (3 << 40) + lo // 8, len(rows), postings.peaks(tf, length), postings.deltas(doc), postings.packed(tf), postings.packed(length)))
    # no call for a block: there are about as many blocks as different words of each window
    for name in ("packed", "deltas", "peaks"):
        monkeypatch.setattr(postings, name, None)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 3))
    batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.list_(pa.string()))], ["doc", "terms"])
    got = [tuple(r.values()) for b in postings._blocks(8)(iter([batch.slice(0, 24), batch.slice(24)])) for r in b.to_pylist()]
    assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_index_gives_the_rows_of_a_scan(spark, docs, queries, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/index"
    third = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    for i in range(3):
        postings.add(docs.where(third == i), folder, window=32, buckets=3)
    want = best(ranking.bm25(docs, queries), 12)
    got, read = searched(spark, folder, queries, 12)
    assert got == want and len(postings.segments(spark, folder)) == 3
    # a theme's words are in few windows: the others are not scored
    assert read[2][1] < 0.5 * read[2][0] and all(b <= a for a, b in read.values())
    merged = f"file://{tmp_path}/merged"
    postings.merge(spark, folder, merged, window=128, buckets=2)
    assert len(postings.segments(spark, merged)) == 1 and postings.blocks(spark, merged).count() < postings.blocks(spark, folder).count()
    assert searched(spark, merged, queries, 12)[0] == want
    assert searched(spark, merged, queries, 2000)[0] == best(ranking.bm25(docs, queries), 2000)
    monkeypatch.setattr(postings, "LISTED_TERMS", 2)  # many terms: joins in place of lists
    assert searched(spark, folder, queries, 12)[0] == want


def test_segment_without_its_note_is_not_read(spark, docs, queries, tmp_path):
    folder = f"file://{tmp_path}/index"
    postings.add(docs, folder)
    want = searched(spark, folder, queries, 5)[0]
    stray = postings.blocks(spark, folder).drop("segment").limit(50)
    stray.write.partitionBy("bucket").parquet(f"{folder}/blocks/segment=half-written")
    assert searched(spark, folder, queries, 5)[0] == want
    empty = f"file://{tmp_path}/empty"
    postings.add(docs.limit(0), empty)
    assert searched(spark, empty, queries, 5) == ([], {})
