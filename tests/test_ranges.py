"""Ranges of a series: windows and runs are those of the whole series, and no task holds it."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from heliospark.operators import temporal as W


def series(kind):
    r = random.Random(8)
    rows, t = [], 0
    for k in ("a", "b", None):
        for i in range(500 if k != "b" else 7):
            t += r.choice([0, 0, 1, 5, 700, 50_000]) if r.random() < 0.9 else 3_000_000
            rows.append((k, None if i < 3 else t, len(rows), None if r.random() < 0.1 else round(r.random() * 9, 3), r.random() < (0.97 if 100 < i < 400 else 0.5) if r.random() > 0.05 else None))
    cast = {"number": "cast(t as long)", "ntz": "cast(timestamp_seconds(t) as timestamp_ntz)", "time": "timestamp_seconds(t)", "date": "date_add(date'2024-01-01', cast(t div 86400 as int))"}[kind]
    return rows, cast


@pytest.mark.parametrize("kind", ["number", "ntz", "time", "date"])
@pytest.mark.parametrize("size", [1, 13, 100, 20_000])
def test_windows_and_runs(spark, monkeypatch, kind, size):
    monkeypatch.setattr(W, "RANGE_ROWS", size)
    rows, cast = series(kind)
    df = spark.createDataFrame(rows, "k string, t long, n long, x double, f boolean").withColumn("ts", F.expr(cast)).repartition(5)
    new = lambda w: {"m": W.past("median", F.col("x"), w, 9), "c": F.count("n").over(w.rowsBetween(-9, -1)), "l": F.lag("n").over(w)}
    want = {r.n: r for r in df.withColumns(new(W.order("k", "ts", "n"))).collect()}
    got = W.over_ranges(df, "k", "ts", "n", before=9, new=new).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.m, r.c, r.l, r.x) == (want[r.n].m, want[r.n].c, want[r.n].l, want[r.n].x)
    up = {}
    points = set()
    order = sorted((r for r in want.values()), key=lambda r: (str(r.k), r.ts is not None, r.ts or 0, r.n)) if kind == "number" else sorted(want.values(), key=lambda r: (str(r.k), r.ts is not None, str(r.ts) if r.ts else "", r.n))
    for _, mine in itertools.groupby(order, key=lambda r: r.k):
        for flag, run in itertools.groupby(mine, key=lambda r: bool(r.f)):
            run = list(run)
            up |= {r.n: i + 1 if flag else 0 for i, r in enumerate(run)}
            if flag and len(run) >= 3:
                points.add(run[len(run) // 2].n)
    assert {r.n: r.run for r in W.with_run(df, "f", "k", "ts", "n").collect()} == up
    assert {r.n for r in W.with_change_points(df, "f", "k", "ts", "n", least=3).where("is_change_point").collect()} == points


def test_one_series_takes_many_tasks(spark):
    df = spark.range(200_000).selectExpr("'a' k", "timestamp_seconds(id * 60) ts", "id n", "cast(id % 97 as double) x", "id % 1000 <> 0 f")
    new = lambda w: {"m": W.past("mean", F.col("x"), w, 60)}
    out = W.over_ranges(df, "k", "ts", "n", before=60, new=new).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        sizes = sorted(r["count"] for r in out.groupBy("task").agg(F.count("*").alias("count"), F.sum("m")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 200_000 and len(sizes) > 1 and sizes[-1] < 150_000
    copies = W.in_ranges(df, "k", "ts", 60).agg(F.count_if("_copy"), F.count_distinct("_range")).first()
    assert copies[1] == 10 and copies[0] <= 9 * 120
    run = W.with_run(df, "f", "k", "ts", "n").agg(F.max("run"), F.count_if(F.col("run") == F.col("n") % 1000)).first()
    assert tuple(run) == (999, 200_000)


def test_no_job_before_an_action(spark):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("ranges"))
    spark.sparkContext.setJobGroup("ranges", "ranges")
    try:
        df = spark.range(100).selectExpr("'a' k", "id ts", "id n", "id % 3 > 0 f")
        W.with_change_points(W.over_ranges(df, "k", "ts", "n", before=5, new=lambda w: {"l": F.lag("n").over(w)}), "f", "k", "ts", "n")
        assert jobs() == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def frames(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_asof_ties_and_frames(spark):
    """Frames that end with the partition are read anew for each row; right rows of one time are told apart by value."""
    left = spark.createDataFrame([(i, 10.0 * i) for i in range(50)], "id int, s double").selectExpr("id", "timestamp_seconds(s) AS t")
    right = [(10.0 * i + side, v) for i in range(50) for side in (-1, 2) for v in range(5)]
    for seed in (1, 2):
        random.Random(seed).shuffle(right)
        for how in ("left", "inner"):
            out = W.asof_nearest(left, spark.createDataFrame(right, "s double, v int").selectExpr("timestamp_seconds(s) AS t", "v"), "t", ["v"], 5.0, ("id",), how)
            assert {(r.id, r.v) for r in out.collect()} == {(i, 4) for i in range(50)}
            assert "unboundedfollowing" not in frames(out)


def test_frames_of_runs(spark):
    df = spark.range(5).selectExpr("'a' AS k", "id AS t", "id % 2 = 0 AS f")
    assert "unboundedfollowing" not in frames(W.with_change_points(df, "f", "k", "t"))
