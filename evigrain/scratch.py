"""Tables written between the steps of a plan, in the folder that driver and executors share.

The folder is that of ``spark.checkpoint.dir``; only in local mode, where it may be unset, a temporary one is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder's URI."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='evigrain-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


class Steps:
    """The steps of one job: each is written and read again, so that no plan grows with their number."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path = spark, f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Removes a step that no later one reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
