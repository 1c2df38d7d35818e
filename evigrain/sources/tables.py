"""Table readers."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task groups at once where rows are dealt out by their number.
ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema; blank lines are skipped, broken ones have nulls."""
    return spark.read.schema(schema).json(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores (a few large row groups) dealt to all of them.

    For row-wise work that costs more than the shuffle. Larger scans stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def tasks_for(spark: SparkSession, rows: int, each: int = ROWS) -> int:
    """As many tasks as ``rows`` need, so that none has many more than ``each``; one a core at least."""
    return max(spark.sparkContext.defaultParallelism, ceil(rows / each))
