"""Streaming extension: minute windows with late rows dropped behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_stream(events: DataFrame, ts: str = "ts", by: str = "event_type", value: str = "value", late: str = "2 minutes") -> DataFrame:
    """Count, mean and median by series and minute; works on batches and streams alike. State holds open windows only."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = e.groupBy(F.window(ts, "1 minute").alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"))
    return out.select(F.col("w.start").alias("minute"), by, "n", "mean", "median")
