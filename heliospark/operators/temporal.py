"""Sequence operators: rows in order of time, by series. Frames count rows, and those that look back exclude the row itself.

A series of any length is dealt to ranges of time of about RANGE_ROWS rows. Frames of a bounded length see a copy of the rows before their range
(over_ranges); runs are carried from range to range by a table with a row a range (runs). So no task has to hold a series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spectrum import let
from .joins import joined


def order(by: str | list[str], *keys: str):
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*keys)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def floor_time(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def derivative(x: Column, ts: Column, w) -> Column:
    """Change a minute; null in the first row and where time stands still."""
    dt = (micros(ts) - micros(F.lag(ts).over(w))) / 60e6
    return F.when(dt > 0, (x - F.lag(x).over(w)) / dt)


def least_rows(n: int) -> int:
    return max(3, min(n, n // 3 or 1))


def past(stat: str, x: Column, w, n: int, least: int | None = None) -> Column:
    """Mean, median, variance (population) or mad of the n rows before; null with fewer than least values."""
    frame = w.rowsBetween(-n, -1)
    least = least_rows(n) if least is None else least
    if stat == "mad":  # unscaled: median distance to the window's median
        middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
        # each sorted array is bound once, the middle takes it twice
        apart = lambda s: let(middle(s), lambda m: let(F.sort_array(F.transform(s, lambda v: F.abs(v - m))), middle))
        return F.when(F.count(x).over(frame) >= least, let(F.sort_array(F.collect_list(x).over(frame)), apart))
    value = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "variance": F.var_pop}[stat](x)
    return F.when(F.count(x).over(frame) >= least, value.over(frame))


#: Rows of a range, about; no fewer than the longest frame.
RANGE_ROWS = 20_000
_NULLS = -(1 << 62)


def _bucket(df: DataFrame, ts: str) -> Column:
    """A number that never falls in the order of ts, nulls first: hours of a time, days of a date, stretches of a number."""
    kind, x = dict(df.dtypes)[ts], F.col(ts)
    if kind == "timestamp_ntz":  # no time zone's changes
        at = F.unix_date(x.cast("date")).cast("long") * 24 + F.hour(x)
    else:
        at = F.floor(micros(x) / 3_600_000_000) if kind == "timestamp" else F.unix_date(x) if kind == "date" else F.floor(x / 1024)
    return F.coalesce(at.cast("long"), F.lit(_NULLS))


def in_ranges(df: DataFrame, by: str | list[str], ts: str, before: int = 0, rows: DataFrame | None = None) -> DataFrame:
    """df with _range, and _copy: whether the row belongs to another range and is here for at least ``before`` rows to stand before each range's first.

    Buckets of time are counted; from these counts, a row a bucket, follow the ranges and which buckets a range needs before it. Nothing runs before an action.
    rows: a frame with the same rows that is cheaper to count, as what df was before columns were added.
    """
    by = [by] if isinstance(by, str) else list(by)
    rows = df if rows is None else rows
    counts = rows.select(*by, _bucket(rows, ts).alias("_bucket"))
    df = df.withColumn("_bucket", _bucket(df, ts))
    every = Window.partitionBy(*by)
    counts = counts.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c")).withColumn("_end", F.sum("_c").over(every.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)))
    counts = counts.withColumn("_range", F.floor((F.col("_end") - F.col("_c")) / F.lit(max(RANGE_ROWS, before))))
    following = F.lead("_range").over(every.orderBy("_bucket"))
    # the ranges that begin fewer than ``before`` rows after this bucket's last
    counts = counts.withColumn("_next", F.when(following != F.col("_range"), following))
    near = F.collect_list("_next").over(every.orderBy("_end").rangeBetween(0, before - 1)) if before else F.array().cast("array<bigint>")
    counts = counts.select(*by, "_bucket", F.col("_range").alias("_own"), F.concat(F.array("_range"), near).alias("_ranges"))
    out = joined(df, counts, [*by, "_bucket"]).withColumn("_range", F.explode("_ranges"))
    return out.withColumn("_copy", F.col("_range") != F.col("_own")).drop("_bucket", "_own", "_ranges")


def over_ranges(df: DataFrame, by: str | list[str], *keys: str, before: int, new: Callable[[object], dict[str, Column]], rows: DataFrame | None = None) -> DataFrame:
    """df with the columns that ``new`` makes of a window by series in the order of keys, whose frames reach back ``before`` rows at most."""
    by = [by] if isinstance(by, str) else list(by)
    dealt = in_ranges(df, by, keys[0], before, rows)
    return dealt.withColumns(new(order([*by, "_range"], *keys))).where(~F.col("_copy")).drop("_range", "_copy")


def runs(df: DataFrame, flag: str, by: str | list[str], *keys: str, rows: DataFrame | None = None) -> DataFrame:
    """df with _up and _down: rows of a run of true flags up to each row and from it on, itself included; 0 where the flag is false or null.

    Within a range, a row's run goes back to the last false flag. What reaches over the range's ends is carried by a table of ranges: of each its
    rows, and how many true ones stand before its first false flag and after its last; ranges without a false flag pass on what they get.
    """
    by = [by] if isinstance(by, str) else list(by)
    dealt = in_ranges(df, by, keys[0], 0, rows).drop("_copy")
    ranged = [*by, "_range"]
    w = order(ranged, *keys)
    false = ~F.coalesce(F.col(flag), F.lit(False))
    dealt = dealt.withColumn("_n", F.row_number().over(w)).withColumn("_stop", F.when(false, F.col("_n")))
    # backwards, not by a frame that ends with the range: that is read anew for each row
    back = Window.partitionBy(*ranged).orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumns({"_last": F.max("_stop").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_first": F.min("_stop").over(back)})
    parts = dealt.groupBy(*ranged).agg(F.count(F.lit(1)).alias("_size"), F.max("_stop").alias("_end"), F.min("_stop").alias("_begin"))
    series = Window.partitionBy(*by)

    for name, place, ends in (("_in", F.col("_range"), F.col("_size") - F.coalesce("_end", F.lit(0))), ("_out", -F.col("_range"), F.coalesce(F.col("_begin") - 1, F.col("_size")))):
        parts = parts.withColumn("_island", F.count("_end").over(series.orderBy(place).rowsBetween(Window.unboundedPreceding, 0)))
        parts = parts.withColumn("_ends", F.sum(ends).over(Window.partitionBy(*by, "_island").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)))
        parts = parts.withColumn(name, F.coalesce(F.lag("_ends").over(series.orderBy(place)), F.lit(0)))
    out = joined(dealt, parts.select(*ranged, "_size", "_in", "_out"), ranged)
    up = F.col("_n") - F.coalesce("_last", -F.col("_in"))
    down = F.coalesce("_first", F.col("_size") + F.col("_out") + 1) - F.col("_n")
    return out.withColumns({"_up": up, "_down": down}).drop("_range", "_n", "_stop", "_last", "_first", "_size", "_in", "_out")


def with_run(df: DataFrame, flag: str, by: str | list[str], *keys: str, out: str = "run", rows: DataFrame | None = None) -> DataFrame:
    """Length of the run of true flags up to each row; null counts as false."""
    return runs(df, flag, by, *keys, rows=rows).withColumn(out, F.col("_up").cast("int")).drop("_up", "_down")


def with_change_points(df: DataFrame, flag: str, by: str | list[str], *keys: str, least: int = 2, out: str = "is_change_point", rows: DataFrame | None = None) -> DataFrame:
    """Marks the upper middle row of each run of at least so many true flags."""
    whole = F.col("_up") + F.col("_down") - 1
    hit = (F.col("_up") > 0) & (whole >= least) & (F.col("_up") - 1 == F.floor(whole / 2))
    return runs(df, flag, by, *keys, rows=rows).withColumn(out, hit).drop("_up", "_down")


def recent(flag: Column, w, rows: int) -> Column:
    """Whether the flag is true in this row or one of so many before."""
    return F.max(flag.cast("int")).over(w.rowsBetween(-rows, 0)) == 1


def spine(df: DataFrame, by: str, ts: str, step: str) -> DataFrame:
    """Every step from the first to the last of each series."""
    ends = df.groupBy(by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    return ends.select(by, F.explode(F.expr(f"sequence(_a, _b, interval {step})")).alias(ts))


def asof_nearest(left: DataFrame, right: DataFrame, ts: str, value: list[str], tolerance_s: float, keys: tuple[str, ...], how: str = "left") -> DataFrame:
    """Each left row with the nearest right row within the tolerance, the earlier of two as near, of right rows of one time the one of the largest value.

    Both sides are dealt to buckets of time of 16 tolerances; right rows near an edge go to both buckets. In a bucket one sort brings the last
    right row before, and one in reverse the first after: both frames grow row by row, where one that ends with the bucket would be read anew for
    each row. Nothing is paired out, and no bucket grows with the length of the series.
    """
    span = int(16 * tolerance_s * 1e6)
    at = micros(F.col(ts))
    edge = F.lit(int(tolerance_s * 1e6))
    r = right.select(F.col(ts), at.alias("_t"), F.struct(at.alias("t"), *value).alias("_r"))
    r = r.withColumn("_bucket", F.explode(F.array_distinct(F.array(F.floor((F.col("_t") - edge) / span), F.floor(F.col("_t") / span), F.floor((F.col("_t") + edge) / span)))))
    l = left.withColumn("_t", at).withColumn("_bucket", F.floor(F.col("_t") / span)).withColumn("_side", F.lit(1))  # noqa: E741
    both = l.unionByName(r.drop(ts).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    # after: left rows come before right ones of the same time, so those are strictly later; of one time the largest value is the last in both
    up, down = (Window.partitionBy("_bucket").orderBy(*at, "_r", *keys).rowsBetween(Window.unboundedPreceding, 0) for at in ((F.asc("_t"), F.asc("_side")), (F.desc("_t"), F.desc("_side"))))
    both = both.withColumn("_before", F.last("_r", True).over(up)).withColumn("_after", F.last("_r", True).over(down)).where("_side = 1")
    back, ahead = F.col("_t") - F.col("_before.t"), F.col("_after.t") - F.col("_t")
    pick = F.when(ahead < F.coalesce(back, F.lit(1 << 62)), F.col("_after")).otherwise(F.col("_before"))
    both = both.withColumn("_m", F.when(F.abs(pick["t"] - F.col("_t")) <= edge, pick))
    if how == "inner":
        both = both.where("_m is not null")
    return both.select(*left.columns, *[F.col(f"_m.{v}").alias(v) for v in value])
