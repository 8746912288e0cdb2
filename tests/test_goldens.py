"""Published results that small inputs reproduce: ranking, label counts, boundaries; and contracts that fail."""

import pytest
from pyspark.sql import functions as F

from heliospark.operators import detector, features, labels, ranking, replay, statistics, validation
from heliospark.operators import evaluation as E
from heliospark.sources import files

# Candidates (time, linear speed, space speed, location, halo) and their published scores.
CANDIDATES = [
    ("2024-08-08 19:48:05", 789.0, 1132.0, "S03W23", "true", 0.8984726085542334),
    ("2024-08-07 19:12:05", 528.0, 901.0, "S07W07", "true", 0.734569371579065),
    ("2024-08-07 02:12:05", 430.0, 617.0, "N25W18", "true", 0.7020606532691843),
    ("2024-08-07 14:12:05", 658.0, 1099.0, "S11E03", "true", 0.668765062491107),
    ("2024-08-08 05:12:05", 250.0, 457.0, "S03W15", "true", 0.5820775111879036),
    ("2024-08-07 03:24:00", 630.0, None, "N19E05", "false", 0.5680023663324778),
    ("2024-08-09 21:36:00", 638.0, None, "S04W40", "true", 0.511511046807469),
]
# Windows (event, interval, start, end), their constant labels, and the published minutes by label.
WINDOWS = [
    ("AUG2024_QUIET_CONTROL_01", "AUG2024_DEMO_INTERVAL", "2024-08-09 12:00", "2024-08-10 08:30", "QUIET"),
    ("AUG2024_COMPLEX_ICME_01", "AUG2024_DEMO_INTERVAL", "2024-08-10 08:31", "2024-08-13 23:59", None),
    ("AUG2024_POST_EVENT_CONTROL_01", "AUG2024_DEMO_INTERVAL", "2024-08-14 00:00", "2024-08-15 23:59", "POST-ICME"),
    ("OCT2024_COMPLEX_ICME_01", "OCT2024_ICME_INTERVAL", "2024-10-10 06:00", "2024-10-11 23:59", "COMPLEX_ICME"),
    ("SEP2024_QUIET_CONTROL_01", "SEP2024_QUIET_INTERVAL", "2024-09-23 15:00", "2024-09-23 23:59", "QUIET"),
    ("NOV2024_ORIENTATION_CONTROL_01", "NOV2024_ORIENTATION_INTERVAL", "2024-11-25 06:30", "2024-11-25 14:10", "ORIENTATION-CONTROL"),
    ("MAR2025_CIR_HSS_01", "MAR2025_CIR_HSS_INTERVAL", "2025-03-08 00:00", "2025-03-10 23:59", "CIR/HSS"),
]
MINUTES = {"QUIET": 2030, "SHOCK": 1, "SHEATH": 1389, "ICME/EJECTA": 3600, "COMPLEX_ICME": 2520, "POST-ICME": 2880, "CIR/HSS": 4320, "ORIENTATION-CONTROL": 461}


def test_ranking(spark):
    df = spark.createDataFrame([c[:5] for c in CANDIDATES], "cme_time string, linear_speed_km_s double, space_speed_km_s double, source_location string, halo string")
    got = ranking.rank_candidates(df.withColumn("cme_time", F.col("cme_time").cast("timestamp_ntz")), F.lit("2024-08-10 12:19:00").cast("timestamp_ntz")).orderBy(F.desc("score")).collect()
    assert [r.score for r in got] == pytest.approx([c[5] for c in CANDIDATES], abs=1e-12)
    odd = spark.createDataFrame([("2024-08-08 00:00:00", None, None, "S1W1", "no"), ("2024-08-08 00:00:00", 0.0, None, None, None)], df.schema).withColumn("cme_time", F.col("cme_time").cast("timestamp_ntz"))
    assert [r.score for r in ranking.rank_candidates(odd, F.lit("2024-08-10 12:19:00").cast("timestamp_ntz")).collect()] == [None, None]


def registry(spark):
    r = spark.createDataFrame([(*w[:4], w[4] or "COMPLEX_ICME", "control") for w in WINDOWS], "event_id string, independent_interval_id string, start_utc string, end_utc string, constant_label string, sample_role string")
    ts = {c: F.col(c).cast("timestamp_ntz") for c in ("start_utc", "end_utc")}
    inner = F.col("event_id") == "AUG2024_COMPLEX_ICME_01"
    at = lambda t: F.when(inner, F.lit(t).cast("timestamp_ntz"))
    return r.withColumns(ts | {"event_class": F.lit("quiet"), "policy": F.when(inner, "ICME_SUBSTRUCTURE").otherwise("CONSTANT"), "pre_shock_label": F.when(inner, "QUIET"), "shock_reference": at("2024-08-10 12:50"), "ejecta_start": at("2024-08-11 12:00"), "ejecta_end": at("2024-08-14 00:00")})


def test_label_counts_and_boundaries(spark):
    r = registry(spark)
    minutes = r.withColumn("timestamp", F.explode(F.expr("sequence(start_utc, end_utc, interval 1 minute)"))).withColumn("label", labels.label(F.col("timestamp")))
    assert {x["label"]: x["count"] for x in minutes.groupBy("label").count().collect()} == MINUTES
    assert [x["label"] for x in minutes.groupBy("label").count().orderBy(labels.rank(F.col("label"))).collect()] == list(MINUTES)
    statuses = r.withColumns({"boundary_status": F.lit("CONFIGURED_PROTOTYPE"), "label_source": F.lit("paper"), "shock_reference_status": F.lit("APPROXIMATE_INTERNAL_BENCHMARK")})
    got = labels.boundary_register(statuses)
    assert got.count() == 2 * 7 + 3
    assert [(x.boundary_type, x.scientific_status) for x in got.where("event_id = 'AUG2024_COMPLEX_ICME_01'").orderBy("boundary_time_utc").collect()] == [
        ("EVENT_WINDOW_START", "CONFIGURED_PROTOTYPE"), ("SHOCK_REFERENCE", "APPROXIMATE_INTERNAL_BENCHMARK"), ("ICME_EJECTA_START", "CONFIGURED_PROTOTYPE"), ("EVENT_WINDOW_END", "CONFIGURED_PROTOTYPE"), ("ICME_EJECTA_END", "CONFIGURED_PROTOTYPE")]
    assert labels.boundaries_inside(minutes, r).count() == 0
    assert labels.boundaries_inside(minutes.where("timestamp < '2024-08-13'"), r).count() == 1


def test_contracts_fail(spark):
    r = registry(spark)
    assert validation.checked_registry(r).select("sample_role", "event_class").distinct().collect() == [("CONTROL", "QUIET")]
    assert validation.checked_policies(r).count() == 7
    for bad in (r.limit(0), r.union(r), r.withColumn("event_class", F.lit("STORM")), r.withColumn("sample_role", F.lit(None).cast("string")), r.withColumn("end_utc", F.expr("start_utc - interval 1 day")), r.withColumn("independent_interval_id", F.lit("one")).withColumn("end_utc", F.expr("end_utc + interval 400 days"))):
        with pytest.raises(ValueError):
            validation.checked_registry(bad)
    for bad in (r.withColumn("policy", F.lit("NONE")), r.withColumn("constant_label", F.lit("PRE-EVENT")), r.withColumn("shock_reference", F.col("ejecta_end"))):
        with pytest.raises(ValueError):
            validation.checked_policies(bad)


def test_spectra_contract(spark):
    ok = spark.createDataFrame([(1, [1.0, 2.0], [0.5, 0.5], [0.1, 0.9])], "time int, energy array<double>, th1_probability array<double>, th2_probability array<double>")
    assert validation.spectra_contract(ok) == (True, "available") and validation.spectra_contract(None) == (False, "missing")
    assert validation.spectra_contract(ok.drop("time")) == (False, "missing keys: time")
    assert not validation.spectra_contract(ok.withColumn("th1_probability", F.array()))[0]
    assert files.read_spectra(spark, "/nowhere") is None


def test_registry_file_and_tables(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("events:\n  - event_id: A\n    negative_control: true\n    start_utc: '2024-01-01T00:00:00'\n    reference_boundaries:\n      - {boundary_type: FRONT, boundary_time_utc: '2024-01-01T01:00:00', scientific_status: S}\n  - event_id: B\n")
    got = files.read_registry(spark, str(tmp_path / "r.yaml")).orderBy("event_id").collect()
    assert got[0].negative_control is True and got[0].start_utc.year == 2024 and got[0].references[0].boundary_time_utc.hour == 1 and got[1].references == [] and got[1].start_utc is None
    row = {c: [1.0, None] for c in files.FEATURES}
    df = spark.createDataFrame([("2024-01-01 00:00:00", "TRUE", *[v[0] for v in row.values()]), ("2024-01-01 00:01:00", "no", *[float("nan") for _ in row])], "timestamp string, usable_opdi string, " + ", ".join(f"{c} double" for c in row))
    files.write_table(df, str(tmp_path / "t"), "csv")
    back = files.read_features(spark, str(tmp_path / "t"), "csv").orderBy("timestamp").collect()
    assert [x.usable_opdi for x in back] == [True, False] and back[0].js_opdi == 1.0 and back[1].js_opdi is None
    files.write_table(df.drop("js_opdi"), str(tmp_path / "u"))
    with pytest.raises(ValueError):
        files.read_features(spark, str(tmp_path / "u"))


def test_dictionary_and_leaks(spark):
    d = features.dictionary(spark)
    assert d.count() == 79 and len(features.model_features(d, "icme_binary")) == 79
    leak = spark.createDataFrame([(99, "x", "research_label", False)], d.schema)
    with pytest.raises(ValueError):
        features.model_features(d.union(leak), "icme_binary")
    assert features.model_features(d.union(leak.withColumn("uses_ground_truth_label", F.lit(True))), "t")[0] == "proton_density"


def channels(spark, n, change=None):
    rows = [("a", i, [float((i * 7 + k * 3) % 23 + (100 if i == change else 0)) for k in range(11)]) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id string, i int, v array<double>")
    names = (*features.CORE, *features.DIVERGENCES)
    return df.select("event_id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, i)").alias("timestamp"), *[F.col("v")[k].alias(c) for k, c in enumerate(names)], F.lit(True).alias("eligible_for_exploratory_modeling"))


def test_features_look_back_only(spark):
    """A changed minute changes no statistic of it or of earlier ones (the whole series' scale apart, which no window here falls back to)."""
    cols = [f"{c}_rolling_{s}_{n}m" for c in features.ROLLED for s in features.STATISTICS for n in (5, 15, 60)] + ["opdi_rolling_median"]
    a, b = (features.feature_matrix(channels(spark, 90, c), "event_id", "timestamp").orderBy("timestamp").collect() for c in (None, 70))
    assert all(x[c] == y[c] for x, y in zip(a[:71], b[:71]) for c in cols) and any(x[c] != y[c] for x, y in zip(a[71:], b[71:]) for c in cols)
    assert {c for _, c in features.dictionary_rows() if c not in features.SHAPES.values()} <= set(a[0].asDict())
    with pytest.raises(ValueError):
        features.feature_matrix(channels(spark, 3).union(channels(spark, 3)), "event_id", "timestamp")


def test_shapes_are_attached_once(spark):
    at = lambda m: F.expr(f"timestamp_ntz'2024-01-01 00:{m:02d}:00'")
    shape = F.struct(*[F.lit(1.0).alias(k) for k in features.SHAPES])
    minutes = spark.range(2).select(F.lit("s").alias("source"), F.when(F.col("id") == 0, at(0)).otherwise(at(1)).alias("timestamp"))
    shapes = spark.range(2).select(F.lit("s").alias("source"), at(0).alias("timestamp"), shape.alias("shape"))
    got = features.attach_shapes(minutes, shapes, "source", "timestamp").orderBy("timestamp").collect()
    assert len(got) == 2 and got[0].th1_th2_cosine_similarity == 1.0 and got[1].th1_th2_cosine_similarity is None


def test_published_detector(spark):
    """All channels and the published steps: a jump far over the published scale is an alert."""
    rows = [(i, *[float((i * k) % 5) + (500.0 if i in (60, 61, 62) else 0.0) for k in range(1, 12)]) for i in range(120)]
    names = (*features.CORE, *features.DIVERGENCES)
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} double" for c in names)).select(F.lit("a").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, i)").alias("timestamp"), "i", *names)
    got = detector.detect(df, "event_id", "timestamp", "i", detector.published(("2024-01-01 00:00:00", "2024-01-01 00:50:00"))).orderBy("i").collect()
    step = lambda r, c: max(0.0, (abs(rows[r][1 + names.index(c)] - rows[r - 4][1 + names.index(c)]) - detector.STEP_PARAMS[c][0]) / detector.STEP_PARAMS[c][1])
    for r in (10, 60, 64, 100):
        assert got[r].transition_score == pytest.approx(sum(w * step(r, c) for c, w in detector.STEP_WEIGHTS.items()), rel=1e-9)
    assert any(x.state == "ALERT" for x in got[58:68])


def test_areas_in_ranges(spark):
    """Sums over ranges of scores equal one sort, ties and groups included."""
    rows = [(g, (i * 37) % 50 / 7, int((i * 11) % 3 == 0), i) for g in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "g string, s double, t int, i int").repartition(5)
    for g in ("a", "b"):
        mine = sorted(((s, t, i) for h, s, t, i in rows if h == g), key=lambda r: (-r[0], r[2]))
        pos, pairs = [r for r in mine if r[1]], [(p[0], n[0]) for p in mine if p[1] for n in mine if not n[1]]
        tp, area, before = 0, 0.0, 1.0
        for k, r in enumerate(mine):
            tp += r[1]
            area += r[1] / len(pos) * (tp / (k + 1) + before) / 2
            before = tp / (k + 1)
        assert statistics.pr_auc_stable(df, "t", "s", "i", by=["g"]).where(F.col("g") == g).first().pr_auc == pytest.approx(area, abs=1e-12)
        assert statistics.roc_auc(df, "t", "s", ["g"]).where(F.col("g") == g).first().roc_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs), abs=1e-12)
    alone = statistics.mann_whitney(df, "g", "s", "a", "none").first()
    assert alone.u is None and alone.p is None
    assert statistics.mann_whitney(df.withColumn("s", F.lit(1.0)), "g", "s", "a", "b").first().p == 1.0


def test_replay(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", 1.0, None), ("2024-01-01 00:03:00", 2.0, "ALERT")], "t string, js_opdi double, state string").select(F.col("t").cast("timestamp_ntz").alias("timestamp"), "js_opdi", "state")
    full = replay.with_replay_columns(df)
    assert set(replay.DETECTOR) <= set(full.columns) and [r.state for r in full.orderBy("timestamp").collect()] == ["NOT AVAILABLE", "ALERT"]
    ref = F.lit("2024-01-01 00:02:00").cast("timestamp_ntz")
    assert replay.primary_transition(full, ref).first().match_time.minute == 2
    assert replay.primary_transition(full.withColumn("is_change_point", F.lit(True)), ref).first().match_time.minute == 1
    assert replay.upload_summary(df).first().states == {"ALERT": 1}
    with pytest.raises(ValueError):
        replay.upload_summary(df.drop("js_opdi"))


def test_few_intervals_fail(spark):
    with pytest.raises(ValueError):
        E.leakage_checks(spark.createDataFrame([("a", 1), ("b", 0)], "i string, t int"), "i", "t")


def test_no_task_of_the_matrix_holds_a_series(spark):
    """The whole series' medians are of counted bins; the plan that remains joins what was found, a row a series, and sorts ranges alone."""
    out = features.feature_matrix(channels(spark, 90), "event_id", "timestamp")
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
