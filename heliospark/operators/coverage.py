"""What of an event or a feed is there, and which rows are fit for modelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import all_there
from .temporal import micros

# Shares from which an event is ready, and a row's features are.
READY, CONVENTIONAL, OPDI = 0.9, 0.7, 0.75


def readiness(rows: DataFrame, registry: DataFrame, modalities: dict[str, list[str]], cadence_min: float = 1.0, least: float = READY, also: Column | None = None) -> DataFrame:
    """By registered event: rows, share of the expected minutes, share of rows with each modality whole, and whether all suffice.

    rows carry event_id. An event without rows has shares of 0. also: a further condition on the registry's columns.
    """
    shares = {m: F.avg(all_there(*map(F.col, names)).cast("double")) for m, names in modalities.items()}
    found = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("records"), *[s.alias(m) for m, s in shares.items()])
    expected = F.floor((micros(F.col("end_utc")) - micros(F.col("start_utc"))) / (cadence_min * 60e6)) + 1
    out = registry.join(found, "event_id", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    out = out.withColumns({"time_coverage": F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("records"), expected)), F.lit(0.0))} | {m: F.coalesce(m, F.lit(0.0)) for m in modalities})
    ready = F.coalesce(also, F.lit(False)) if also is not None else F.lit(True)
    for c in ("time_coverage", *modalities):
        ready = ready & (F.col(c) >= least)
    return out.select("event_id", "records", "time_coverage", *modalities, ready.alias("ready"))


def feed_quality(df: DataFrame, by: list[str], ts: str, complete: str, step_s: int = 60) -> DataFrame:
    """Rows, first and last time, whether each step has one row, repeated times and complete rows. One aggregate, nothing is sorted.

    Steps are regular if no time repeats, all times have one rest by the step, and there are as many as fit between the ends.
    """
    at, step = micros(F.col(ts)), int(step_s * 1e6)
    rest = F.pmod(at, F.lit(step))
    out = df.groupBy(*by).agg(
        F.count(ts).alias("records"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.count_distinct(ts).alias("_d"), F.min(rest).alias("_r"), F.max(rest).alias("_s"), F.count_if(F.col(complete)).alias("valid"), F.avg(F.coalesce(F.col(complete), F.lit(False)).cast("double")).alias("valid_fraction")
    )
    fit = (micros(F.col("last")) - micros(F.col("first"))) / step + 1
    regular = (F.col("_d") == F.col("records")) & (F.col("_r") == F.col("_s")) & (F.col("records") == fit)
    return out.select(*by, "records", "first", "last", F.coalesce(regular, F.lit(True)).alias("continuous"), (F.col("records") - F.col("_d")).alias("duplicates"), "valid", "valid_fraction")


def eligibility(ready: Column, complete: Column, confidence: Column, conventional: Column, opdi: Column) -> dict[str, Column]:
    """Whether a row may be explored, confirmed with, and has enough of its features (shares); null is no."""
    explore = F.coalesce(ready & complete, F.lit(False))
    high = F.coalesce(confidence == "HIGH", F.lit(False))
    enough = F.coalesce((conventional >= CONVENTIONAL) & (opdi >= OPDI), F.lit(False))
    return {"exploratory": explore, "confirmatory": explore & high, "features_ready": explore & enough}
