"""Files and tables in the folder that driver and executors share.

The folder is the one in ``spark.checkpoint.dir``. Only where that is unset and Spark runs in local mode
(tests, a notebook) a temporary folder is made and set; on a cluster an unset folder is an error.

What a result no longer needs is removed when the result is handed out. The rest stays as long as the lazy
result may be read: :func:`scope` removes it at the end of a block in which results are written; results
used otherwise leave it in the folder, whose own retention applies. Executors write array files under names of their own and return the
names, so a repeated task leaves a stray file at worst and never changes one in use.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAGIC = b"EVARRAY1"
OPEN_FILES = 2048
OPEN_BYTES = 8 << 30
_open: OrderedDict[str, tuple[dict[str, np.ndarray], int]] = OrderedDict()


def shared_folder(spark: SparkSession) -> str:
    """The URI of the shared folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='evigrain-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{os.path.abspath(found)}"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


_scope: ContextVar[list[Store] | None] = ContextVar("scope", default=None)


@contextmanager
def scope() -> Iterator[None]:
    """Removes the stores made in its block when the block ends: for results that are written in it."""
    made: list[Store] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        for store in made:
            store.remove()


def remove(spark: SparkSession, uri: str) -> None:
    """Removes a folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Store:
    """One job's own folder under the shared one."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.uri = spark, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        if (made := _scope.get()) is not None:
            made.append(self)

    def remove(self) -> None:
        remove(self.spark, self.uri)

    def keep_only(self, *names: str) -> None:
        """Removes all that isn't named: called when the result no longer reads it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in files.listStatus(path) if files.exists(path) else ():
            if found.getPath().getName() not in names:
                files.delete(found.getPath(), True)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it again: later stages start from the files, whatever executors are lost."""
        df.write.parquet(f"{self.uri}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.uri}/{name}")


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes named arrays to one new file; returns its URI."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex}.arr"
    fs, path = _filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    at, head = 0, {}
    for k, a in arrays.items():
        head[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    start = -(-(16 + len(text)) // 64) * 64
    with fs.open_output_stream(path) as out:
        out.write(_MAGIC + len(text).to_bytes(8, "little") + text + b"\0" * (start - 16 - len(text)))
        for a in arrays.values():
            out.write(memoryview(np.ascontiguousarray(a)).cast("B") if len(a) else b"")
            out.write(b"\0" * (-a.nbytes % 64))
    return uri


def open_arrays(uri: str) -> dict[str, np.ndarray]:
    """Memory-maps a file of :func:`write_arrays`.

    A remote file is first copied to a local one, which is unlinked at once and so lives as long as its
    mapping. The latest ``OPEN_FILES`` files of together ``OPEN_BYTES`` stay open.
    """
    if uri in _open:
        _open.move_to_end(uri)
        return _open[uri][0]
    fs, path = _filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as tmp, fs.open_input_stream(path) as src:
            while block := src.read(1 << 22):
                tmp.write(block)
            tmp.flush()
            raw = np.memmap(tmp, np.uint8, "r")
    assert raw[:8].tobytes() == _MAGIC, f"{uri} is not an array file"
    n = int.from_bytes(raw[8:16].tobytes(), "little")
    start = -(-(16 + n) // 64) * 64
    out = {}
    for k, (kind, length, at) in json.loads(raw[16 : 16 + n].tobytes()).items():
        dtype = np.dtype(kind)
        out[k] = raw[start + at : start + at + length * dtype.itemsize].view(dtype)
    _open[uri] = out, len(raw)
    while len(_open) > OPEN_FILES or (len(_open) > 1 and sum(size for _, size in _open.values()) > OPEN_BYTES):
        _open.popitem(last=False)
    return out


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """About how many bytes ``df`` reads: Catalyst's estimate for a plain scan; else ``text`` is measured.

    Catalyst multiplies the sizes of joined tables and knows nothing of RDDs, so such estimates aren't taken.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    leaves = plan.collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size <= read < 1 << 60:
        return size
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def cut(total: int, each: int, least: int = 1, most: int = 1 << 20) -> int:
    """Number of parts of about ``each`` in ``total``."""
    return int(min(max(-(-total // each), least), most))
