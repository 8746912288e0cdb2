"""What a replay asks of scored minutes: whole columns, one minute's evidence, the main transition, a quick look at an upload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import require_columns
from .learning import ensemble
from .temporal import micros

# Columns of the detector, and what is shown for a state.
CHANNELS = ("js_opdi", "hellinger_opdi", "wasserstein_opdi", "proton_bulk_speed", "proton_density", "proton_thermal", "alpha_proton_ratio", "bmag_gse", "Bx_gse", "By_gse", "Bz_gse")
SCORES = ("opdi_anomaly_score", "plasma_anomaly_score", "mag_anomaly_score", "conventional_anomaly_score", "combined_anomaly_score")
STEPS = ("bmag_gse", "proton_bulk_speed", "proton_thermal", "proton_density", "js_opdi")
DETECTOR = (*[f"z_{c}" for c in CHANNELS], *SCORES, *[f"transition_component_{c}" for c in STEPS], "transition_score")
NO_STATE, DATA_ONLY = "NOT AVAILABLE", "DATA ONLY"


def with_replay_columns(df: DataFrame) -> DataFrame:
    """df with all columns of a replay: scores that are missing stay null, flags become false and states NOT AVAILABLE. Nothing is inferred."""
    had = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    new = {c: F.lit(None).cast("double") for c in DETECTOR if c not in df.columns}
    new |= {c: F.coalesce(had(c, "boolean"), F.lit(False)) for c in ("transition_threshold_exceeded", "is_change_point")}
    return df.withColumns(new | {"state": F.coalesce(had("state", "string"), F.lit(NO_STATE)), "ground_truth_state": had("ground_truth_state", "string")})


def shown(state: Column) -> Column:
    """A state as displayed."""
    return F.when(F.coalesce(state, F.lit(DATA_ONLY)) == DATA_ONLY, NO_STATE).otherwise(state)


def prediction_at(predictions: DataFrame, interval: str, at: Column) -> DataFrame:
    """The models' ensemble at exactly this minute of an interval; no row if there is no prediction, and no nearest one instead."""
    mine = predictions.where((F.col("independent_interval_id") == interval) & (F.col("timestamp") == at))
    return ensemble(mine, "independent_interval_id", "timestamp")


def primary_transition(df: DataFrame, reference: Column, ts: str = "timestamp", *values: str) -> DataFrame:
    """The change point nearest to the reference (the earlier of two), its offset in minutes and values; and match_time, the reference without one."""
    off = (micros(F.col(ts)) - micros(reference)) / 60e6
    row = F.struct(F.col(ts).alias("detected_at"), off.alias("offset_minutes"), *values)
    one = df.where("is_change_point").agg(F.min_by(row, F.struct(F.abs(off), F.col(ts))).alias("_r"))
    return one.select("_r.*", F.coalesce("_r.detected_at", reference).alias("match_time"))


def upload_summary(df: DataFrame) -> DataFrame:
    """Rows and median JS of an uploaded table, and minutes by state as a map (null without states); fails if time or JS is missing."""
    require_columns(df, "timestamp", "js_opdi")
    out = df.agg(F.count(F.lit(1)).alias("records"), F.percentile(F.col("js_opdi").cast("double"), F.lit(0.5)).alias("js_median"))
    if "state" not in df.columns:
        return out.withColumn("states", F.lit(None).cast("map<string,bigint>"))
    states = df.where("state is not null").groupBy("state").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("state", "n"))).alias("states"))
    return out.join(F.broadcast(states))
