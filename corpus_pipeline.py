"""A corpus pipeline of four operators: quality, line deduplication, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows, written as Parquet and read
again, are the next stage's ``docs``. All stages but the last return the columns of ``documents``.

Each stage takes rows with nulls in any column, empty and very long texts, repeated rows and ids, and tables
without rows (which give none). Columns beyond those of ``documents`` are left out, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm import _bpe, _store, line_dedup, minhash, packing, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
QUALITY_THRESHOLD = 0.3
SEQUENCE = 2048


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score below 0.3)."""
    columns = _columns(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_quality(docs, labels, QUALITY_THRESHOLD, keep=columns)
    return scored.where("predicted = 1").select(*columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines from the texts; a document that has lost all its lines goes.

    Documents that were empty before stay as they are. ``n_chars`` follows the text.
    """
    columns = _columns(docs)
    out = line_dedup.dedup_lines(docs, keep=[c for c in columns if c not in ("doc_id", "text")])
    out = out.where("n_dropped < n_lines").withColumn("text", F.col("kept_text"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest doc_id, of each group of near-duplicates (five-word shingles, 80 %).

    Of rows with the same ``doc_id`` the kept id keeps all.
    """
    found = minhash.near_duplicates(docs, width=5, percent=80)
    gone = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens: one row for each piece."""
    return packing.pack(docs, _bpe.vocabulary("word_bpe_49k.json"), SEQUENCE)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: No SQL: stages 1 and 4 hold a trained network and a tokenizer. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each over the written result of the one before.

    What a stage put into the shared folder goes when its result is written, and each result when the next
    one is; the last stays for the caller.
    """
    folder = f"{_store.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for name, stage in STAGES:
        with _store.scope():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            _store.remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
