"""The tables' stand-ins for the engine's inputs, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTERVAL = "CASE event_type WHEN 'click' THEN 'I1' WHEN 'view' THEN 'I2' WHEN 'purchase' THEN 'I3' ELSE 'I4' END"
TARGET = "CASE WHEN event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15' THEN 1 WHEN event_type = 'purchase' THEN 1 ELSE 0 END"
SERIES = f"SELECT event_type AS event_id, {INTERVAL} AS independent_interval_id, ts AS timestamp, event_id AS seq, CASE WHEN event_id % 37 = 0 THEN NULL ELSE value END AS x, CAST(user_id AS DOUBLE) AS y, {TARGET} AS target FROM events"
BASELINE = ("2024-01-01 00:00:00", "2024-01-05 00:00:00")
REFERENCE = "2024-01-10 00:00:00"
REGISTRY = [("W1", "click", "2024-01-02 00:00:00", "2024-01-06 00:00:00"), ("W2", "click", "2024-01-05 00:00:00", "2024-01-12 00:00:00"), ("W3", "view", "2024-01-08 00:00:00", "2024-01-16 00:00:00"), ("W4", "error", "2024-01-20 00:00:00", "2024-01-29 00:00:00"), ("W5", "signup", "2024-02-20 00:00:00", "2024-02-21 00:00:00")]
#: event_id, policy, constant_label, pre_shock_label, shock_reference, ejecta_start, ejecta_end
POLICIES = [("W1", "CONSTANT", "QUIET", None, None, None, None), ("W2", "ICME_SUBSTRUCTURE", None, "QUIET", "2024-01-08 12:00:00", "2024-01-09 06:00:00", "2024-01-10 18:00:00"), ("W3", "CONSTANT", "CIR/HSS", None, None, None, None), ("W4", "CONSTANT", "COMPLEX_ICME", None, None, None, None), ("W5", "CONSTANT", "QUIET", None, None, None, None)]
#: cme_time, linear speed, space speed, location, halo: invented
CANDIDATES = [("2024-08-08 02:24:00", 500.0, None, "S09E30", "false"), ("2024-08-07 14:00:00", 780.0, 810.0, "N10W05", "true"), ("2024-08-08 19:30:00", 960.0, None, "S07W20", "halo"), ("2024-08-09 05:00:00", 1200.0, 1400.0, None, "0"), ("2024-08-06 01:00:00", 240.0, None, "unknown", "yes")]
RANK_REFERENCE = "2024-08-10 12:19:00"


def _sql(v, kind: str) -> str:
    return f"CAST(NULL AS {kind})" if v is None else (str(v) if kind == "DOUBLE" else f"TIMESTAMP '{v}'" if kind == "TIMESTAMP" else f"'{v}'")


def values_sql(rows: list[tuple], names: list[str], kinds: list[str]) -> str:
    body = " UNION ALL ".join("SELECT " + ", ".join(f"{_sql(v, k)} AS {n}" for v, n, k in zip(r, names, kinds)) for r in rows)
    return body


REGISTRY_SQL = values_sql(REGISTRY, ["event_id", "source", "start_utc", "end_utc"], ["VARCHAR", "VARCHAR", "TIMESTAMP", "TIMESTAMP"])
POLICY_SQL = values_sql(POLICIES, ["event_id", "policy", "constant_label", "pre_shock_label", "shock_reference", "ejecta_start", "ejecta_end"], ["VARCHAR"] * 4 + ["TIMESTAMP"] * 3)
CANDIDATE_SQL = values_sql(CANDIDATES, ["cme_time", "linear_speed_km_s", "space_speed_km_s", "source_location", "halo"], ["TIMESTAMP", "DOUBLE", "DOUBLE", "VARCHAR", "VARCHAR"])
EDGES = "(ln(2100.0) - ln(320.0)) / 63"
BINS_SQL = f"SELECT vec_id // 2 AS minute_id, vec_id % 2 AS plane, label, i - 1 AS k, exp(ln(320.0) + (i - 1) * {EDGES}) AS e, CASE WHEN abs(embedding[i]) < 0.004 THEN NULL ELSE CAST(abs(embedding[i]) AS DOUBLE) END AS f FROM embeddings, range(1, 65) r(i)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    x = F.when(F.col("event_id") % 37 != 0, F.col("value"))
    return e.select(F.col("event_type").alias("event_id"), F.expr(INTERVAL).alias("independent_interval_id"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"), x.alias("x"), F.col("user_id").cast("double").alias("y"), F.expr(TARGET.replace("TIMESTAMP", "TIMESTAMP_NTZ")).alias("target"))


def _rows(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql.replace("VARCHAR", "STRING").replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)").replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))


def registry(spark: SparkSession) -> DataFrame:
    return _rows(spark, REGISTRY_SQL)


def policies(spark: SparkSession) -> DataFrame:
    return _rows(spark, POLICY_SQL)


def candidates(spark: SparkSession) -> DataFrame:
    return _rows(spark, CANDIDATE_SQL.replace("DOUBLE)", "DOUBLE)"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, minute_id, plane, label and flux, the 64 bins with gaps."""
    v = table(spark, sf_dir, "embeddings")
    flux = F.transform("embedding", lambda x: F.when(F.abs(x) >= 0.004, F.abs(x).cast("double")))
    return v.select("vec_id", F.expr("vec_id div 2").alias("minute_id"), (F.col("vec_id") % 2).alias("plane"), "label", flux.alias("flux"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra(spark, sf_dir)
    return s.where("plane = 0").select("minute_id", F.col("flux").alias("f1")).join(s.where("plane = 1").select("minute_id", F.col("flux").alias("f2")), "minute_id")
