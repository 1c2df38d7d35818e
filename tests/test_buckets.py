"""Tables in hash buckets with versions."""

import random

import pytest

from evigrain.buckets import BucketTable, Conflict

ROWS = "k long, name string, n int"


def start(spark, tmp_path, count=1000, buckets=64):
    rows = [(k, f"name {k}", k % 7) for k in range(count)]
    return BucketTable.create(spark.createDataFrame(rows, ROWS), f"file://{tmp_path}/t", "k", buckets), {r[0]: r for r in rows}


def told(df):
    out = {r.k: tuple(r) for r in df.collect()}
    return out


def test_upserts_equal_a_dictionary(spark, tmp_path):
    table, want = start(spark, tmp_path, 300, 8)
    pick = random.Random(3)
    for _ in range(3):
        changes = [(pick.randrange(400), f"new {k}", k, pick.random() < 0.3) for k in range(60)] + [(None, "x", 0, False)]
        table.upsert(spark.createDataFrame(changes, "k long, name string, n int, gone boolean"), order="n", deleted="gone")
        for k, name, n, gone in changes:
            if gone:
                want.pop(k, None)
            elif k is not None:
                want[k] = (k, name, n)
        assert told(table.read()) == want
    assert table.version()["number"] == 4


def test_an_upsert_rewrites_what_it_touches(spark, tmp_path):
    table, want = start(spark, tmp_path)
    before = table.version()
    assert table.upsert(spark.createDataFrame([(5, "five"), (5000, "more")], "k long, name string")) <= 2
    after = table.version()
    assert sum(before["writes"][b] != after["writes"][b] for b in before["writes"]) <= 2
    assert told(table.read(before)) == want  # a reader keeps its version
    assert told(table.read(keys=[5, 6, 5000, 9999])) == {5: (5, "five", None), 6: want[6], 5000: (5000, "more", None)}
    plan = table.read(keys=[5])._jdf.queryExecution().toString()
    assert plan.count("_b=") <= 4


def test_ties_take_the_largest_row_and_extra_columns_are_left_out(spark, tmp_path):
    table, _ = start(spark, tmp_path, 3, 2)
    table.upsert(spark.createDataFrame([(1, "a", 5, 0), (1, "b", 5, 0), (1, "a", 5, 0)], "k long, name string, n int, _b int"))
    assert told(table.read())[1] == (1, "b", 5) and table.read().columns == ["k", "name", "n"]


def test_writers_that_die_or_meet(spark, tmp_path):
    table, want = start(spark, tmp_path, 20, 4)
    base = table.version()
    table._written(spark.createDataFrame([(1, "lost", 0)], ROWS), base)  # dies before its version is there
    assert told(table.read()) == want
    table.upsert(spark.createDataFrame([(1, "first", 0)], ROWS), version=base)
    with pytest.raises(Conflict):
        table.upsert(spark.createDataFrame([(2, "second", 0)], ROWS), version=base)
    assert told(table.read()) == {**want, 1: (1, "first", 0)} and not list((tmp_path / "t" / "drafts").glob("[!.]*"))
    table.upsert(spark.createDataFrame([(2, "second", 0)], ROWS))
    assert told(table.read())[2][1] == "second"


def test_empty_tables_and_changes(spark, tmp_path):
    none = spark.createDataFrame([], ROWS)
    table = BucketTable.create(none, f"file://{tmp_path}/t", "k", 4)
    assert table.read().count() == 0 and table.upsert(none) == 0 and table.version()["number"] == 1
    assert table.upsert(spark.createDataFrame([(1, "a", 1)], ROWS)) == 1 and table.read().count() == 1
    table.upsert(spark.createDataFrame([(1, True)], "k long, gone boolean"), deleted="gone")
    assert table.read().count() == 0 and table.version()["writes"] == {}
