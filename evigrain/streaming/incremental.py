"""Structured Streaming twins: ingest, subscriptions, job states, sessions.

Each runs from a checkpoint, so a restart goes on where it stopped; sinks are idempotent by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ranking import small

# A job's stages, in order.
STAGES = ("queued", "extracting", "chunking", "analysing", "building", "loading", "indexing", "embedding", "done")


def ingest(files: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Adds files (sha256, path, ...) whose content isn't in the table yet, each content once.

    Contents are laid out by their first two digits, so a batch reads the known hashes of its own parts only,
    and of each one column.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        others = [c for c in batch.columns if c != "sha256"]
        new = batch.groupBy("sha256").agg(F.min_by(F.struct(*others), "path").alias("r")).select("sha256", "r.*")
        new = new.withColumns({"part": F.left("sha256", F.lit(2)), "batch": F.lit(number)})
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            parts = [r.part for r in new.select("part").distinct().collect()]  # 256 at most
            known = spark.read.schema("sha256 string, part string, batch long").parquet(table)
            new = new.join(known.where(F.col("part").isin(parts) & (F.col("batch") != number)).select("sha256"), "sha256", "left_anti")
        # a batch that comes again replaces itself
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(table)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def notify(items: DataFrame, subscriptions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes, for each subscription (sub_id, topic, cursor), the streamed items (topic, at) newer than its cursor."""
    met = items.join(small(subscriptions), "topic").where(F.col("at") > F.col("cursor"))
    return met.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def job_states(events: DataFrame) -> DataFrame:
    """The furthest stage of each job (job_id, stage, at), with its progress; updates as events come.

    An event of an earlier stage, or after ``done``, changes nothing.
    """
    place = {s: i for i, s in enumerate(STAGES)}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else -1
        for f in frames:
            best = max([best, *(place[s] for s in f["stage"] if s in place)])
        state.update((best,))
        if best >= 0:
            yield pd.DataFrame({"job_id": [key[0]], "stage": [STAGES[best]], "progress": [best / (len(STAGES) - 1)]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string, stage string, progress double", "best int", "update", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each user in sessions that a pause of ``gap`` ends; later events than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def usage(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by type in fixed windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


class _Timed(StatefulProcessor):
    """One value for each key, that a timer on event time removes."""

    value = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("kept", self.value)

    def until(self, at: int) -> None:
        """Only the last timer counts."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def _millis(times: pd.Series) -> list[int]:
    return [int(x.timestamp() * 1000) for x in times]


class _Cache(_Timed):
    value = "made long"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        made = self.state.get()[0] if self.state.exists() else None
        asked = sorted(x for f in rows for x in zip(_millis(f["at"]), f["request_id"], strict=True))
        hits = []
        for at, _ in asked:
            hits.append(made is not None and made <= at <= made + self.ttl)
            made = made if hits[-1] else at
        self.state.update((made,))
        self.until(made + self.ttl + 1)
        yield pd.DataFrame({"k": key[0], "request_id": [r for _, r in asked], "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"k": [], "request_id": [], "hit": []}).astype({"k": str, "request_id": int, "hit": bool})


def cached_answers(requests: DataFrame, ttl: int, late: str = "0 seconds") -> DataFrame:
    """Requests (k, request_id, at) with ``hit``: whether an answer of their key was made at most ``ttl`` milliseconds before.

    A request without one makes it. Answers are forgotten once the watermark has passed their time, so the state
    holds what may still be hit. Requests of a key count in order of time within a batch; those without a time are
    left out. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = requests.select("k", F.col("request_id").cast("long").alias("request_id"), "at").where("at IS NOT NULL").withWatermark("at", late)
    return rows.groupBy("k").transformWithStateInPandas(_Cache(ttl), "k string, request_id long, hit boolean", "Append", "EventTime")


class _Jobs(_Timed):
    value = "best int, seen long"

    def __init__(self, patience: int):
        self.patience = patience

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best, seen = self.state.get() if self.state.exists() else (-1, 0)
        for f in rows:
            best = max([best, *(STAGES.index(s) for s in f["stage"] if s in STAGES)])
            seen = max([seen, *_millis(f["at"])])
        self.state.update((best, seen))
        self.until(seen + self.patience)
        yield self.row(key, STAGES[best] if best >= 0 else None, best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best = self.state.get()[0]
        self.state.clear()
        yield self.row(key, "timed_out", best).iloc[int(best == len(STAGES) - 1) :]  # what is done only goes

    @staticmethod
    def row(key, stage, best) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "stage": pd.Series([stage], dtype=object), "progress": [max(best, 0) / (len(STAGES) - 1)]})


def timed_jobs(events: DataFrame, patience: int, late: str = "0 seconds") -> DataFrame:
    """The furthest stage of each job (job_id, stage, at), and ``timed_out`` for one that nothing was heard of for ``patience`` milliseconds.

    By event time: the watermark must have passed. Jobs that are done or timed out leave the state; an event
    after that begins anew. Events without a time are left out; unknown stages change nothing but the time. Needs
    the RocksDB state store.
    """
    rows = events.select("job_id", "stage", "at").where("at IS NOT NULL").withWatermark("at", late)
    return rows.groupBy("job_id").transformWithStateInPandas(_Jobs(patience), "job_id string, stage string, progress double", "Update", "EventTime")
