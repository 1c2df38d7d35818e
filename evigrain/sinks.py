"""Writers: tables, JSON lines, exports, upserts of a written table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.graph import upsert


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Parquet, atomically by Spark's commit protocol; ``by`` are partition columns."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def upsert_table(changes: DataFrame, path: str, fresh: str, key: str, order: str | None = None) -> DataFrame:
    """Writes the table at ``path`` with ``changes`` applied to ``fresh`` and returns it: a version, never in place."""
    spark = changes.sparkSession
    out = upsert(spark.read.parquet(path), changes, key, order)
    write_table(out, fresh)
    return spark.read.parquet(fresh)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key isn't in the table yet."""
    known = rows.sparkSession.read.parquet(path).select(key)
    rows.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").parquet(path)


def json_ld(name: Column, fields: dict[str, Column]) -> Column:
    """A JSON-LD object with provenance."""
    body = [F.lit("http://www.w3.org/ns/prov#").alias("@context"), F.lit("Entity").alias("@type"), name.alias("name"), *[c.alias(k) for k, c in fields.items()]]
    return F.to_json(F.struct(*body))


def markdown_table(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row with the table as markdown. For small results: the rows meet in one value."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return df.agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["l"]), "\n")).alias("markdown"))
