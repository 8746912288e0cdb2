"""Ranks candidate source events of a transition by direction, halo, speed and transit time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the ranking.
AU_KM = 149_597_870.7
WEIGHTS = {"transit": 0.45, "direction": 0.25, "halo": 0.20, "speed": 0.10}
HALO_TEXTS = ("true", "1", "yes", "y", "halo")


def direction(location: Column) -> Column:
    """1 at the disk's centre, less with latitude and longitude; 0.5 if the text names no place."""
    text = F.upper(F.trim(location))
    part = lambda i: F.regexp_extract(text, r"^([NS])(\d{1,2})([EW])(\d{1,2})", i)
    near = lambda i: F.greatest(F.lit(0.0), 1 - part(i).cast("double") / 90)
    return F.when(F.coalesce(part(2), F.lit("")) != "", 0.5 * near(2) + 0.5 * near(4)).otherwise(F.lit(0.5))


def halo(text: Column) -> Column:
    return F.when(F.coalesce(F.lower(F.trim(text)).isin(*HALO_TEXTS), F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.2))


def rank_candidates(df: DataFrame, reference: Column) -> DataFrame:
    """cme_time, linear_speed_km_s, space_speed_km_s, source_location and halo, with the parts and the score. Without a speed, or with none, parts and score that need one are null."""
    speed = F.coalesce("space_speed_km_s", "linear_speed_km_s")
    hours = (F.unix_micros(reference.cast("timestamp")) - F.unix_micros(F.col("cme_time").cast("timestamp"))) / 3600e6
    df = df.withColumns({"speed_used": speed, "transit_hours": hours, "ballistic_hours": F.try_divide(F.lit(AU_KM), speed) / 3600})
    df = df.withColumns({"transit_score": F.exp(-F.abs(F.col("transit_hours") - F.col("ballistic_hours")) / 30), "direction_score": direction(F.col("source_location")), "halo_score": halo(F.col("halo").cast("string")), "speed_score": F.when(F.col("speed_used").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("speed_used") - 250) / 1000)))})
    return df.withColumn("score", sum((w * F.col(f"{k}_score") for k, w in WEIGHTS.items()), F.lit(0.0)))
