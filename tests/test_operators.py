import math

import pytest
from pyspark.sql import functions as F

from heliospark.functions import missing as M
from heliospark.functions import spectrum as S
from heliospark.operators import labels as L
from heliospark.operators import ranking as R
from heliospark.operators import temporal as W
from heliospark.sources import files


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def arr(xs):
    return F.array(*[F.lit(x).cast("double") for x in xs])


P, Q = (0.5, 0.25, 0.125, 0.0625, 0.0625), (0.0625, 0.0625, 0.125, 0.25, 0.5)


def test_divergences(spark):
    GRID = S.grid_column([320.0, 500.0, 800.0, 1300.0, 2100.0])
    same = one(spark, S.divergences(arr(P), arr(P), GRID, 5))
    assert max(map(abs, same)) < 1e-12
    apart, back = one(spark, S.divergences(arr(P), arr(Q), GRID, 5)), one(spark, S.divergences(arr(Q), arr(P), GRID, 5))
    assert min(apart) > 0 and apart.js == pytest.approx(back.js) and apart.hellinger == pytest.approx(back.hellinger)
    assert one(spark, S.divergences(arr(P), arr([None] * 5), GRID, 5)) is None


def test_missing(spark):
    assert one(spark, M.clean_flux(F.lit(-1e31))) is None and one(spark, M.clean_flux(F.lit(float("nan")))) is None
    assert one(spark, M.clip_low(F.lit(None).cast("double"))) is None and one(spark, M.clip_low(F.lit(-2.0))) == 0
    assert one(spark, M.row_median(F.lit(3.0), F.lit(None).cast("double"), F.lit(1.0))) == 2
    assert one(spark, M.ratio(F.lit(1.0), F.lit(0.0))) is None


def test_regrid_inside_alone(spark):
    points = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(f).alias("f")) for e, f in ((400.0, 1.0), (100.0, 10.0), (1600.0, 0.25), (400.0, 7.0))])
    got = one(spark, S.regrid(points, [50.0, 100.0, 800.0, 2000.0], 2))
    assert got[0] is None and got[3] is None and got[1] == pytest.approx(10) and got[2] == pytest.approx(math.sqrt(0.25))


def test_runs_and_change_points(spark):
    df = spark.createDataFrame([("a", i, bool(v)) for i, v in enumerate([1, 1, 0, 1, 1, 1, 0, 1])], "k string, t int, f boolean")
    assert [r.run for r in W.with_run(df, "f", "k", "t").orderBy("t").collect()] == [1, 2, 0, 1, 2, 3, 0, 1]
    assert [r.t for r in W.with_change_points(df, "f", "k", "t").where("is_change_point").orderBy("t").collect()] == [1, 4]


def test_asof_prefers_the_earlier(spark):
    at = lambda s: F.expr(f"timestamp_ntz'2024-01-01 00:00:{s:02d}'")
    left = spark.range(1).select(at(10).alias("ts"), F.lit(1).alias("id"))
    right = spark.range(2).select(F.when(F.col("id") == 0, at(8)).otherwise(at(12)).alias("ts"), F.col("id").alias("r"))
    assert W.asof_nearest(left, right, "ts", ["r"], 3.0, ("id",)).first().r == 0
    assert W.asof_nearest(left, right, "ts", ["r"], 1.0, ("id",)).first().r is None
    assert W.asof_nearest(left, right, "ts", ["r"], 1.0, ("id",), "inner").count() == 0


def test_past_only(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(6)], "k string, t int, x double")
    got = df.select("t", W.past("median", F.col("x"), W.order("k", "t"), 5).alias("m")).orderBy("t").collect()
    assert [r.m for r in got] == [None, None, None, 1.0, 1.5, 2.0]


def test_contracts(spark):
    df = spark.createDataFrame([("a",), ("a",)], "event_id string")
    with pytest.raises(ValueError):
        L.require_unique(df, "event_id")
    with pytest.raises(ValueError):
        L.require_columns(df, "x")
    with pytest.raises(ValueError):
        L.require_same_events(df, spark.createDataFrame([("b",)], "event_id string"))


def test_direction(spark):
    assert one(spark, R.direction(F.lit("n00w00"))) == 1 and one(spark, R.direction(F.lit(None).cast("string"))) == 0.5


def test_reference_feed(spark, tmp_path):
    head, bare = tmp_path / "a.csv", tmp_path / "b.csv"
    row = "2024-01-01T00:00:00Z,1,2,3,400,5,99999999"
    head.write_text("timestamp,omni_Bx_gse,omni_By_gse,omni_Bz_gse,omni_flow_speed,omni_proton_density,omni_temperature\n" + row + "\n")
    bare.write_text(row + "\n")
    for f in (head, bare):
        r = files.read_reference_csv(spark, str(f)).first()
        assert r.omni_Bx_gse == 1 and r.omni_temperature is None and not r.omni_complete
    bare.write_text(row + "\n" + row + "\n")
    with pytest.raises(ValueError):
        files.read_reference_csv(spark, str(bare))
    assert files.inventory(spark, str(tmp_path), "*.csv").count() == 2


def test_files(spark, tmp_path):
    names = spark.createDataFrame([("x_20240810_a_V02.cdf",), ("w_20240810_a_V02.cdf",), ("notes.txt",)], "name string")
    assert [tuple(r) for r in files.day_files(names).collect()] == [(None, "20240810", "V02", "w_20240810_a_V02.cdf")]
    kinds = spark.createDataFrame([(f"AL1_{k}_20240810_L2_V02.cdf",) for k in ("TH1", "TH2", "BLK")] + [("AL1_TH1_20240811_L2_V02.cdf",)], "name string")
    found = files.day_files(kinds)
    assert found.count() == 4 and [tuple(r) for r in files.paired_days(found).collect()] == [("20240810", "V02")]
    assert [tuple(r) for r in files.coverage_matrix(spark, found, "2024-08-10", "2024-08-11", ("TH1", "BLK")).orderBy("date").collect()] == [("20240810", "OK", "OK", True), ("20240811", "OK", "MISSING", False)]
    day = files.placeholder_day(spark, "2024-08-10", ["x"])
    assert day.count() == 1440 and day.where("x is not null or usable_opdi").count() == 0
    assert files.write_report(spark.range(1).toDF("n"), str(tmp_path / "r")) == {"n": 0}


def test_stream(spark, tmp_path):
    from heliospark.streaming.minutes import minute_stream

    src = "/root/testdata/sf0.001/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001/")
    q = minute_stream(stream).writeStream.format("memory").queryName("minutes").outputMode("append").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    batch = minute_stream(spark.read.parquet(src))
    assert 0 < spark.table("minutes").count() <= batch.count()
    assert spark.table("minutes").exceptAll(batch).count() == 0


def test_feed_quality(spark):
    from heliospark.operators.coverage import feed_quality

    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = [("a", at(m), m > 0) for m in (0, 1, 2)] + [("b", at(m), True) for m in (0, 1, 3)] + [("c", at(m), None) for m in (5, 5)]
    df = spark.createDataFrame(rows, "k string, t string, ok boolean").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r.k: (r.continuous, r.duplicates, r.valid) for r in feed_quality(df, ["k"], "t", "ok").collect()}
    assert got == {"a": (True, 0, 2), "b": (False, 0, 3), "c": (False, 1, 0)}


def test_saved_model(spark, tmp_path):
    from heliospark.operators import learning

    df = spark.createDataFrame([(float(i), float(i % 3), int(i > 20)) for i in range(40)], "x double, y double, target int")
    fitted = learning.fit(df, "logistic", ["x", "y"], "target")
    learning.save_bundle(spark, fitted, str(tmp_path / "m"), ["x", "y"])
    want = [r.probability for r in learning.predict(fitted, df).orderBy("x").collect()]
    again = learning.score_bundle(spark, str(tmp_path / "m"), df).orderBy("x").collect()
    assert [r.probability for r in again] == want and sum(r.predicted == r.target for r in again) > 34
    with pytest.raises(ValueError):
        learning.score_bundle(spark, str(tmp_path / "m"), df.drop("y"))
