"""Quantiles by bins and brackets, null groups, and operators that run nothing before an action."""

import random

import pytest
from pyspark.sql import functions as F

from heliospark.operators import evaluation as E
from heliospark.operators import statistics as T
from heliospark.plans import catalogue

SF = "/root/testdata/sf0.001"
SHARES = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q99": 0.99, "high": 1.0}


def values():
    r = random.Random(6)
    big = [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(150)]
    groups = {"ties": [1.0] * 50 + [2.0] * 50, "one": [7.5], "none": [None, None], "two": [1.0, 2.0], "normal": [r.gauss(0, 1) for _ in range(400)], "near": [1000 + r.random() * 1e-9 for _ in range(99)], "big": big, "zero": [0.0, -0.0, 5e-324, -5e-324, None], "endless": [float("inf"), float("-inf"), 1.0, 2.0, 3.0], None: [3.0, None, 4.0, 9.0], "whole": [float(i % 7) for i in range(100)]}
    return [(g, v) for g, vs in groups.items() for v in vs]


def test_equals_percentile(spark):
    df = spark.createDataFrame(values(), "g string, x double").repartition(5)
    want = {r.g: r for r in df.groupBy("g").agg(*(F.percentile("x", F.lit(q)).alias(n) for n, q in SHARES.items())).collect()}
    got = {r.g: r for r in T.quantiles(df, ["g"], "x", SHARES).collect()}
    assert set(got) == set(want) and None in got
    for g, w in want.items():
        for n in SHARES:
            assert got[g][n] == w[n] or got[g][n] != got[g][n] and w[n] != w[n], (g, n, got[g][n], w[n])
    whole = T.quantiles(df.where("g != 'endless'"), [], "x", SHARES).first()
    assert tuple(whole) == tuple(df.where("g != 'endless'").agg(*(F.percentile("x", F.lit(q)) for q in SHARES.values())).first())
    assert T.quantiles(df.limit(0), ["g"], "x", SHARES).count() == 0


def test_bins_never_fall(spark):
    xs = sorted(v for _, v in values() if v is not None)
    rows = spark.createDataFrame([(v,) for v in xs], "x double").select("x", T.bin_of(F.col("x")).alias("b")).collect()
    bins = [b for _, b in sorted((r.x, r.b) for r in rows)]
    assert bins == sorted(bins) and len(set(bins)) > 300


def test_null_groups_stay(spark):
    r = random.Random(1)
    rows = [(g, i % 2, r.random() + (i % 2) * 0.3, i) for g in ("a", None) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, y int, s double, i int")
    for f in (T.roc_auc, T.pr_auc_distinct):
        got = {x.g: x[1] for x in f(df, "y", "s", ["g"]).collect()}
        assert set(got) == {"a", None}
        for g in got:
            part = df.where(F.col("g").eqNullSafe(F.lit(g)))
            assert got[g] == pytest.approx(f(part, "y", "s").first()[0])
    assert {x.g for x in T.pr_auc_stable(df, "y", "s", "i", by=["g"]).collect()} == {"a", None}
    assert {x.g for x in T.center_scale(df, ["g"], "s").collect()} == {x.g for x in T.robust_params(df, ["g"], "s").collect()} == {"a", None}


@pytest.mark.parametrize("name", ["loo_predictions", "detector_states", "roc_auc"])
def test_no_job_before_an_action(spark, name):
    if name not in catalogue.QUERIES:
        pytest.skip("not in the catalogue")
    spark.sparkContext.setJobGroup(f"lazy {name}", name)
    try:
        catalogue.QUERIES[name](spark, SF)
        # Spark's own look at a file's schema is a job, one a table
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"lazy {name}")) <= 4
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_too_many_intervals_fail(spark, monkeypatch):
    monkeypatch.setattr(E, "MOST_FOLDS", 5)
    df = spark.range(20).selectExpr("cast(id % 6 as string) i")
    with pytest.raises(Exception, match="more than 5 intervals"):
        E.folds(df, "i").count()
    assert E.folds(df.where("i < '5'"), "i").count() == 5 * df.where("i < '5'").count()


def test_counted_params(spark):
    """Counted values give what the rows give: with spread, without any, with quartiles alone, without values."""
    from heliospark.operators.statistics import robust_params

    groups = {"a": [1.0, 2.0, 2.0, 7.0, None], "b": [3.0] * 5, "c": [1.0] * 6 + [4.0, 5.0, 6.0], "d": [None], "e": [1.0] * 9 + [2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    plain = {r.k: (r.center, r.scale) for r in robust_params(df, ["k"], "v").collect()}
    counted = {r.k: (r.center, r.scale) for r in robust_params(df.groupBy("k", "v").count(), ["k"], "v", "count").collect()}
    assert plain.keys() == counted.keys() and all(plain[k] == pytest.approx(counted[k], rel=1e-12) for k in plain)


def test_scores_compile(spark):
    """Lambdas are interpreted row by row, and methods of over 8,000 bytes are never compiled by the JVM."""
    import re

    from heliospark.plans import catalogue

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = catalogue.QUERIES["mode_predictions"](spark, "/root/testdata/sf0.001")
        text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000
