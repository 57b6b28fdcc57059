"""Skew-safe window helpers equal their plain single-window forms."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from routeledger.functions.windows import running_totals


@pytest.mark.parametrize("seed_no", [1, 2])
def test_running_totals_equal_plain_window_on_hot_key(spark, seed_no):
    rnd = random.Random(seed_no)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = 0 if rnd.random() < 0.6 else rnd.randint(1, 30)          # one key holds ~60 % of rows
        ts = start + dt.timedelta(hours=rnd.randint(0, 24 * 40))
        rows.append((key, ts, i, rnd.randint(-50, 50)))
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, id long, v long")
    got = running_totals(df, ["k"], ["ts", "id"], {"run": "v"}, inclusive=True)
    got_ex = running_totals(df, ["k"], ["ts", "id"], {"run": "v"}, inclusive=False)
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = df.withColumn("run", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
              .withColumn("run_ex", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                               F.lit(0)))
    a = {r.id: r.run for r in got.collect()}
    b = {r.id: (r.run, r.run_ex) for r in plain.collect()}
    c = {r.id: r.run for r in got_ex.collect()}
    assert a == {i: v[0] for i, v in b.items()}
    assert c == {i: v[1] for i, v in b.items()}


def test_running_totals_keep_nulls_and_split_one_day(spark):
    rows = [(None if i % 10 == 0 else 1, None if i % 7 == 0 else dt.datetime(2024, 1, 1), i, 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, id long, v long")
    got = running_totals(df, ["k"], ["ts", "id"], {"run": "v"})
    plain = df.withColumn("run", F.sum("v").over(Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted((r.id, r.run) for r in got.collect()) == sorted((r.id, r.run) for r in plain.collect())
    from routeledger.session import materialize
    ranged = materialize(df.repartitionByRange(4, "k", "ts", "id").withColumn("p", F.spark_partition_id()), "test-ranges")
    assert ranged.filter("k = 1 and ts is not null").select("p").distinct().count() > 1


def test_running_totals_join_no_sorted_rows(spark):
    """The rows aren't shuffled and sorted once more for the totals of earlier ranges, at any size of the rows."""
    df = spark.createDataFrame([(k, i, i % 7 - 3) for k in (None, 1, 2, 3) for i in range(200)], "k int, ts int, v int")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {c: spark.conf.get(c) for c in names}
    try:
        for c in names:
            spark.conf.set(c, "-1")
        got = running_totals(df, ["k"], ["ts"], {"run": "v"})
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        rows = {(r["k"], r["ts"]): r["run"] for r in got.collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert rows == {(k, i): sum(j % 7 - 3 for j in range(i + 1)) for k in (None, 1, 2, 3) for i in range(200)}


def test_keys_of_a_task_s_share_are_shuffled_once(spark, monkeypatch):
    """Small keys are written nowhere and shuffled once; hot keys are spread; both give the plain window's rows."""
    from routeledger.functions import windows
    rows = [(None if i % 3 == 0 else i % 40, None if i % 7 == 0 else i // 5, i, i % 9 - 4) for i in range(1200)]
    df = spark.createDataFrame(rows, "k int, ts int, id int, v int")
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = sorted((r.id, r.run or 0) for r in df.withColumn("run", F.sum("v").over(w)).collect())
    cold, hot = windows.split_hot(df, ["k"])
    assert hot is None and cold.count() == 1200
    got = running_totals(df, ["k"], ["ts", "id"], {"run": "v"}, inclusive=False)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.id, r.run) for r in got.collect()) == want
    monkeypatch.setattr(windows, "HOT_ROWS", 100)
    cold, hot = windows.split_hot(df, ["k"])
    assert [r.k for r in hot.select("k").distinct().collect()] == [None] and cold.count() + hot.count() == 1200
    got = running_totals(df, ["k"], ["ts", "id"], {"run": "v"}, inclusive=False)
    assert sorted((r.id, r.run) for r in got.collect()) == want
