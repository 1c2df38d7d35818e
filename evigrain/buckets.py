"""A keyed table in hash buckets, with versions: an upsert rewrites the buckets that it touches, and no others.

``data/<write>/_b=<bucket>/`` holds files of a write; ``versions/<number>.json`` names, for each bucket, the write
whose files hold it. A version is there once its text is, under a name that nobody else could take, so

- a reader keeps the version that it opened, whatever is written meanwhile,
- a writer that dies before the end leaves files that no version names,
- of two writers that began from one version, the second fails with :class:`Conflict` and can begin again.

The driver holds one short string for each bucket. Choose the number of buckets for the table's size at its end: a
bucket of some 100 MB is read and written by one task. Columns ``_b``, ``_o`` and ``_gone`` are the table's own.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has made the next version."""


class BucketTable:
    """The table at ``path``; :meth:`create` makes a new one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int) -> BucketTable:
        """A new table of ``rows``, whose keys must be unique and not null (not checked: see ``state.not_unique``)."""
        out = cls(rows.sparkSession, path)
        state = {"number": 0, "key": key, "buckets": buckets, "schema": rows.schema.jsonValue(), "writes": {}}
        out._commit(state, out._written(rows, state))
        return out

    def version(self) -> dict:
        """The last version: its number, key, buckets, schema and the write of each bucket. Pass it to reads that must agree."""
        folder = self._hadoop(f"{self.path}/versions")
        names = [f.getPath().getName() for f in folder.getFileSystem(self._conf()).listStatus(folder)]
        last = max(int(n[:-5]) for n in names if n.endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.path}/versions/{last}.json", wholetext=True).first()[0])

    def read(self, version: dict | None = None, keys: list | None = None) -> DataFrame:
        """The rows of a version (the last one), or those of a few ``keys``, from their buckets alone."""
        v = version or self.version()
        if keys is None:
            return self._buckets(v, list(v["writes"]))
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType([f for f in StructType.fromJson(v["schema"]) if f.name == v["key"]]))
        places = [str(r[0]) for r in asked.select(_bucket(v)).distinct().collect()]
        return self._buckets(v, places).where(F.col(v["key"]).isin(keys))

    def upsert(self, changes: DataFrame, order: str | None = None, deleted: str | None = None, version: dict | None = None) -> int:
        """Writes the next version: rows of ``changes`` in place of those with their key; returns how many buckets were rewritten.

        The change with the largest ``order`` counts for a key; of equal ones, or without an order, the largest row.
        Rows with a true ``deleted`` remove their key. Columns that the table doesn't have are left out, missing ones
        are null, and a null key changes nothing. ``changes`` is read twice. ``version``: the one to build on.
        """
        v = version or self.version()
        key, names = v["key"], [f["name"] for f in v["schema"]["fields"]]
        lacking = {f.name: F.lit(None).cast(f.dataType) for f in StructType.fromJson(v["schema"]) if f.name not in changes.columns}
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        ranked = changes.where(F.col(key).isNotNull()).withColumns({**lacking, "_gone": gone, "_o": F.col(order) if order else F.lit(0)})
        row = F.struct(F.struct(*[n for n in names if n != key]).alias("r"), "_gone")
        last = ranked.groupBy(key).agg(F.max_by(row, F.struct("_o", row)).alias("x"))
        last = last.select(*[F.col(n) if n == key else F.col(f"x.r.{n}").alias(n) for n in names], "x._gone")
        touched = sorted(str(r[0]) for r in changes.where(F.col(key).isNotNull()).select(_bucket(v)).distinct().collect())
        if not touched:
            return 0
        kept = self._buckets(v, touched).join(last.select(key), key, "left_anti").select(*names)
        made = self._written(kept.unionByName(last.where(~F.col("_gone")).select(*names)), v)
        self._commit(v, {b: made.get(b) for b in touched})
        return len(touched)

    def _buckets(self, v: dict, places: list[str]) -> DataFrame:
        paths = [f"{self.path}/data/{v['writes'][b]}/_b={b}" for b in places if b in v["writes"]]
        schema = StructType.fromJson(v["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _written(self, rows: DataFrame, v: dict) -> dict[str, str]:
        """Writes rows by bucket, one file each; returns the write of each bucket that has rows."""
        name = uuid.uuid4().hex
        target = f"{self.path}/data/{name}"
        rows.withColumn("_b", _bucket(v)).repartition(F.col("_b")).write.partitionBy("_b").parquet(target)
        folder = self._hadoop(target)
        names = [f.getPath().getName() for f in folder.getFileSystem(self._conf()).listStatus(folder)]
        return {n[3:]: name for n in names if n.startswith("_b=")}

    def _commit(self, v: dict, made: dict[str, str | None]) -> None:
        writes = {b: w for b, w in {**v["writes"], **made}.items() if w}
        text = json.dumps({**v, "number": v["number"] + 1, "writes": writes})
        drafted = self._hadoop(f"{self.path}/drafts/{uuid.uuid4().hex}")
        final = self._hadoop(f"{self.path}/versions/{v['number'] + 1}.json")
        files = drafted.getFileSystem(self._conf())
        files.mkdirs(final.getParent())
        out = files.create(drafted)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(options, 0)
        try:  # fails where the name is taken, in one step
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf()).rename(drafted, final, none)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            files.delete(drafted, False)
            raise Conflict(f"version {v['number'] + 1} of {self.path} is there already") from e

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()


def _bucket(v: dict) -> Column:
    return F.pmod(F.xxhash64(F.col(v["key"])), F.lit(v["buckets"])).cast("int").alias("_b")
