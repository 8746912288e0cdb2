"""Joins by equal keys, null being equal to null. Which side is sent to all tasks is left to what Spark measures at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined(df: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with side's other columns. side may come of df, and has other columns than df but for the keys; without keys it has one row."""
    if not keys:
        return df.join(F.broadcast(side))
    side = side.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *(F.col(c).alias(c) for c in side.columns if c not in keys))
    match = df[keys[0]].eqNullSafe(side["_key0"])
    for i, k in enumerate(keys[1:], 1):
        match = match & df[k].eqNullSafe(side[f"_key{i}"])
    return df.join(side, match, how).drop(*(f"_key{i}" for i in range(len(keys))))
