"""State that expires, with a clock that the events move; sketches of parts against exact statistics."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from evigrain.operators import sketches
from evigrain.streaming import incremental

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, old)


def batches(spark, tmp_path, schema, steps, plan, mode):
    """Runs each step's rows as a batch; returns what each gave, and how many keys the state held after it."""
    told, kept = [], []
    for i, rows in enumerate(steps):
        rows = [tuple(T0 + timedelta(seconds=x[1]) if isinstance(x, tuple) else x for x in r) for r in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = []
        live = plan(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        run = live.writeStream.foreachBatch(lambda b, _, out=out: out.extend(map(tuple, b.collect()))).outputMode(mode)
        run = run.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
        told.append(sorted(out, key=repr))
        kept.append([p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]][-1])
    return told, kept


def at(seconds):
    return ("at", seconds)


def test_cached_answers_expire(rocks, tmp_path):
    steps = [
        [("a", 1, at(0)), ("a", 2, at(5)), ("b", 3, at(0)), ("a", 9, None)],
        [("a", 4, at(10)), ("a", 5, at(11))],  # 10 s after it was made: still there; 11: made anew
        [("c", 6, at(100))],
        [("a", 7, at(101))],
    ]
    told, kept = batches(rocks, tmp_path, "k string, request_id long, at timestamp", steps, lambda s: incremental.cached_answers(s, 10_000), "append")
    assert told == [[("a", 1, False), ("a", 2, True), ("b", 3, False)], [("a", 4, True), ("a", 5, False)], [("c", 6, False)], [("a", 7, False)]]
    assert kept[-1] <= kept[0]  # a and b are gone, whatever came since


def test_stuck_jobs_time_out(rocks, tmp_path):
    steps = [
        [("x", "queued", at(0)), ("y", "extracting", at(0)), ("y", "done", at(1)), ("z", "unknown", at(0))],
        [("x", "chunking", at(50)), ("x", "queued", at(51))],
        [("w", "queued", at(500))],
        [("x", "loading", at(501))],
    ]
    told, _ = batches(rocks, tmp_path, "job_id string, stage string, at timestamp", steps, lambda s: incremental.timed_jobs(s, 60_000), "update")
    seen = [[(j, s) for j, s, _ in t] for t in told]
    assert seen[0] == [("x", "queued"), ("y", "done"), ("z", None)]
    assert ("x", "chunking") in seen[1]
    later = [r for t in seen[1:] for r in t]
    assert ("x", "timed_out") in later and ("z", "timed_out") in later and ("y", "timed_out") not in later
    assert ("x", "loading") in seen[3]


def test_sketches_of_parts(spark):
    """Parts that arrive one after the other give what all rows at once give, within the stated bounds."""
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("double").alias("v"), F.pmod(F.xxhash64("id"), F.lit(15_000)).alias("u"), (F.col("id") % 5).alias("part"))
    rows = rows.unionByName(spark.createDataFrame([(9, None, None, 0)], "g long, v double, u long, part long"))
    parts = [sketches.kept(rows.where(F.col("part") == i), "v", "u", ["g"]) for i in range(5)]
    table = parts[0]
    for p in parts[1:]:
        table = sketches.added(table.unionByName(p), ["g"])
    ranks = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r.g: r for r in sketches.merged(table, ["g"], ranks).collect()}
    for g in range(3):
        own = rows.where(F.col("g") == g)
        exact = own.agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.min("v").alias("a"), F.max("v").alias("b"), F.countDistinct("u").alias("d")).first()
        r = got[g]
        assert (r.n, r.total, r.least, r.most) == (exact.n, exact.s, exact.a, exact.b)
        assert abs(r.n_distinct - exact.d) <= sketches.DISTINCT_ERROR * exact.d
        below = own.agg(*[F.avg((F.col("v") < q).cast("double")) for q in r.quantiles]).first()
        assert all(abs(x - y) <= sketches.RANK_ERROR for x, y in zip(below, ranks, strict=True))
    assert (got[9].n, got[9].total, got[9].mean, got[9].quantiles, got[9].n_distinct) == (0, None, None, None, 0)
    assert sketches.merged(table.where("g > 100"), ["g"], ranks).count() == 0
