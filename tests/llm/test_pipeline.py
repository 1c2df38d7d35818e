"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from evigrain.llm import _bpe

from . import brute
from .test_operators import brute_lines, check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of each stage, and the last output, as written."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_columns(stages):
    for df in stages[:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality(stages):
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    before, after = ({r.doc_id for r in df.collect()} for df in stages[:2])
    assert after < before
    apart = [i for i in labels if brute.fold(i, 5) == 0]
    right = sum((i in after) == (labels[i] == 1) for i in apart)
    assert right / len(apart) > 0.85


def test_lines(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {i: sha for i, n, gone, sha in brute_lines(rows) if gone < n}
    import hashlib

    got = {r.doc_id: (hashlib.sha256(r.text.encode()).hexdigest(), r.n_chars == len(r.text)) for r in stages[2].collect()}
    assert got == {i: (sha, True) for i, sha in want.items()}


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {i for i, _, _, kept in brute.components(rows, 5) if kept}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_packing(stages):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(_bpe.vocabulary("word_bpe_49k.json")), []
    import zlib

    for r in stages[3].collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    used = check_packing(stages[4].collect(), want, 2048)
    assert used <= 1 - (-sum(w[3] for w in want) // 2048)


def test_run(spark, stages):
    key = lambda df: sorted((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[4])


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines string, _text string, rank int"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one line of some text\nand more", "en", "a", 30), (3, "one line of some text\nand more", "en", "a", 30)]
    rows += [(None, "one line of some text\nown words here", None, "b", 5), (None, None, None, None, None), (-4, "one line of some text", "de", "b", 1), (9, long, "en", "c", 1), (10, long + " end", "en", "c", 1)]
    return spark.createDataFrame([(*r, 1.0, "x", "y", 2) for r in rows], ODD)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_clashing_columns(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, odd.limit(0), SF).collect() == []
    found = stage(spark, odd, SF)
    ids = sorted(-9 if r.doc_id is None else r.doc_id for r in found.collect())
    if name != "packing":
        assert found.columns == list(corpus_pipeline.COLUMNS)
    if name == "line_dedup":  # rows of ids above -4 lose the shared line; row 1 and 2 were empty before
        assert ids == [-9, -9, -4, 1, 2, 3, 3, 9, 10]
    if name == "near_dedup":
        assert ids == [-9, -9, -4, 1, 2, 3, 3, 9]
    if name == "packing":
        assert set(ids) == {-9, -4, 1, 2, 3, 9, 10} and sum(r.length for r in found.collect() if r.doc_id == 9) > 30_000
    if name == "quality":
        assert set(ids) <= {-9, -4, 1, 2, 3, 9, 10}
