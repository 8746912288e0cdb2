"""Robust scales, tests and classifier metrics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .joins import joined

MAD = 1.4826
IQR = 1.349
TINY = 1e-12


def median(x: str) -> Column:
    return F.percentile(x, F.lit(0.5))


#: Bins to a factor of e.
FINE = 1024


def bin_of(x: Column) -> Column:
    """A whole number that never falls as x grows: logarithmic bins of a thousandth, mirrored at 0. NaN is the largest value, as for Spark."""
    x = x.cast("double")
    endless = F.abs(x) == float("inf")
    size = F.when(endless, F.lit(1 << 40)).otherwise(F.floor(F.log(F.when(~endless, F.abs(x))) * FINE) + 800 * FINE)
    return F.when(F.isnan(x), F.lit(1 << 41)).when(x > 0, size).when(x < 0, -size).when(x.isNotNull(), F.lit(0)).cast("long")


def quantiles(df: DataFrame, by: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each share (by its name): what ``percentile`` gives, exactly, null without a value; groups may be null.

    No task holds a group's values. They are counted by bin, added up before the shuffle; the bins that hold the asked ranks are bracketed, and
    only their rows are counted by value, in a second pass. Nothing runs before an action.
    """
    rows = df.select(*by, F.col(x).cast("double").alias("_x")).withColumn("_bin", bin_of(F.col("_x")))
    group, ordered = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy(*by, "_bin").agg(F.count("_x").alias("_c")).withColumns({"_cum": F.sum("_c").over(ordered), "_all": F.sum("_c").over(group)})
    at = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    asked = F.array(*(F.struct(F.lit(n).alias("name"), at(q).alias("at"), r(at(q)).cast("long").alias("rank")) for n, q in shares.items() for r in (F.floor, F.ceil)))
    # of each bin the ranks that it holds, less the values before it
    held = F.filter(asked, lambda a: (a["rank"] >= F.col("_cum") - F.col("_c")) & (a["rank"] < F.col("_cum")))
    found = bins.where("_c > 0").select(*by, "_bin", F.explode(F.array_distinct(held)).alias("_a"), (F.col("_cum") - F.col("_c")).alias("_before"))
    brackets = found.select(*by, "_bin").distinct().withColumn("_in", F.lit(True))
    if not by:  # two rows a share at most
        brackets = F.broadcast(brackets)
    keys = [*by, "_bin"]
    values = joined(rows.where("_x is not null"), brackets, keys).groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    values = values.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.col("_a.rank") - F.col("_before")
    picked = joined(values, found, keys).where((rank >= F.col("_cum") - F.col("_c")) & (rank < F.col("_cum")))
    part = lambda n, side: F.max(F.when((F.col("_a.name") == n) & (F.col("_a.rank") == side("_a.at")), F.col("_x")))
    place = lambda n: F.max(F.when(F.col("_a.name") == n, F.col("_a.at")))
    ends = picked.groupBy(*by).agg(*(c for n in shares for c in (part(n, F.floor).alias(f"_l{n}"), part(n, F.ceil).alias(f"_h{n}"), place(n).alias(f"_p{n}"))))

    def between(n: str) -> Column:
        low, high, p = F.col(f"_l{n}"), F.col(f"_h{n}"), F.col(f"_p{n}")
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(n)

    if by:  # groups without a value too
        ends = joined(df.select(*by).distinct(), ends, by, "left")
    return ends.select(*by, *(between(n) for n in shares))


def _with_median(df: DataFrame, by: list[str], x: str, times: Column | int = 1) -> DataFrame:
    return joined(df, df.groupBy(*by).agg(F.percentile(x, F.lit(0.5), times).alias("_m")), by)


def center_scale(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Median and 1.4826 MAD; without spread the sample deviation, else 1. Groups may be null."""
    d = _with_median(df, by, x).withColumn("_d", F.abs(F.col(x) - F.col("_m")))
    out = d.groupBy(*by).agg(F.first("_m").alias("center"), (median("_d") * MAD).alias("_a"), F.stddev_samp(x).alias("_b"))
    return out.select(*by, "center", F.coalesce(F.when(F.col("_a") > 0, F.col("_a")), F.when(F.col("_b") > 0, F.col("_b")), F.lit(1.0)).alias("scale"))


def robust_params(df: DataFrame, by: list[str], x: str, times: str | None = None) -> DataFrame:
    """Median and 1.4826 MAD; else the quartile range, else the population deviation, else 1. No values: center 0. Groups may be null.

    times: a column that says how many equal rows a row stands for.
    """
    n = 1 if times is None else F.col(times)
    d = _with_median(df, by, x, n).withColumn("_d", F.abs(F.col(x) - F.col("_m")))
    share = lambda c, q: F.percentile(c, F.lit(q), n)
    if times is None:
        deviation = F.stddev_pop(x)
    else:  # around the median, where it is 0 without spread
        mean = lambda v: F.sum(n * v) / F.sum(F.when(F.col(x).isNotNull(), n))
        off = F.col(x) - F.col("_m")
        deviation = F.sqrt(F.greatest(mean(off * off) - mean(off) * mean(off), F.lit(0.0)))
    out = d.groupBy(*by).agg(F.first("_m").alias("_c"), (share("_d", 0.5) * MAD).alias("_a"), ((share(x, 0.75) - share(x, 0.25)) / IQR).alias("_q"), deviation.alias("_b"))
    pick = [F.when(F.col(c) > TINY, F.col(c)) for c in ("_a", "_q", "_b")]
    return out.select(*by, F.coalesce("_c", F.lit(0.0)).alias("center"), F.coalesce(*pick, F.lit(1.0)).alias("scale"))


def confusion(df: DataFrame, by: list[str], target: str, predicted: str) -> DataFrame:
    cell = lambda t, p: F.count_if((F.col(target) == t) & (F.col(predicted) == p)).cast("long")
    out = df.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return out.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def cumulated(df: DataFrame, by: list[str], order: str, sums: dict[str, str], *ties: str, descending: bool = True) -> DataFrame:
    """df with running sums (name: of column) in the order of one number, equal ones by ties, in each group (null too); the row itself is counted.

    Rows are dealt to bins of the number. Each bin is summed by itself, and the sums before a bin are added: a row a bin and group. So no
    task has to order more than a bin, and nothing runs before an action.
    """
    df = df.withColumn("_range", bin_of(F.col(order)) * (-1 if descending else 1))
    first = F.desc(order) if descending else F.asc(order)
    inside = Window.partitionBy(*by, "_range").orderBy(first, *ties).rowsBetween(Window.unboundedPreceding, 0)
    parts = df.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    df = joined(df.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}), parts, [*by, "_range"])
    return df.withColumns({n: (F.col(n) + F.col(f"_before_{n}")).cast("double") for n in sums}).drop("_range", *[f"_before_{n}" for n in sums])


def _by_score(df: DataFrame, by: list[str], target: str, score: str) -> DataFrame:
    """Rows by group and distinct score: positives, negatives, and both cumulated from the highest score on."""
    g = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(target).cast("double").alias("_p"), (F.count(F.lit(1)) - F.sum(target)).cast("double").alias("_n"))
    return cumulated(g, by, score, {"tp": "_p", "fp": "_n"})


def roc_auc(df: DataFrame, target: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Share of pairs in the right order, ties half; null with one class."""
    by = by or []
    g = _by_score(df, by, target, score)
    area = F.sum(F.col("_n") * (F.col("tp") - F.col("_p") / 2))
    return g.groupBy(*by).agg(F.try_divide(area, F.sum("_p") * F.sum("_n")).alias("roc_auc"))


def pr_auc_distinct(df: DataFrame, target: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Trapezes over recall of the points at distinct scores, from (0, 1) on; null with one class.

    A point knows the one before it: its own counts less what it adds itself. Before the first, precision is 1.
    """
    by = by or []
    g = _by_score(df, by, target, score).withColumns({"_tp0": F.col("tp") - F.col("_p"), "_all0": F.col("tp") + F.col("fp") - F.col("_p") - F.col("_n")})
    part = F.col("_p") * (F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")) + F.coalesce(F.try_divide(F.col("_tp0"), F.col("_all0")), F.lit(1.0))) / 2
    return g.groupBy(*by).agg(F.when((F.sum("_p") > 0) & (F.sum("_n") > 0), F.sum(part) / F.sum("_p")).alias("pr_auc"))


def pr_auc_stable(df: DataFrame, target: str, score: str, *ties: str, by: list[str] | None = None) -> DataFrame:
    """The same row by row; equal scores in the order of ties."""
    by = by or []
    d = df.where(F.col(score).isNotNull()).withColumns({"_one": F.lit(1), "_y": F.col(target).cast("double")})
    d = cumulated(d, by, score, {"tp": "_y", "i": "_one"}, *ties)
    part = F.col("_y") * (F.col("tp") / F.col("i") + F.coalesce(F.try_divide(F.col("tp") - F.col("_y"), F.col("i") - 1), F.lit(1.0))) / 2
    return d.groupBy(*by).agg(F.when((F.sum("_y") > 0) & (F.sum("_y") < F.count(F.lit(1))), F.sum(part) / F.sum("_y")).alias("pr_auc"))


def mann_whitney(df: DataFrame, group: str, x: str, first: str, second: str) -> DataFrame:
    """U of the first group, Cliff's delta and the normal two-sided p with tie and continuity correction; null if a group is empty."""
    g = df.where(F.col(x).isNotNull() & F.col(group).isin(first, second)).groupBy(x).agg(F.count_if(F.col(group) == first).cast("double").alias("_a"), F.count_if(F.col(group) == second).cast("double").alias("_b"))
    t = F.col("_a") + F.col("_b")
    g = cumulated(g, [], x, {"_below": "_b"}, descending=False)
    g = g.withColumns({"_u": F.col("_a") * (F.col("_below") - F.col("_b") / 2), "_t": t * t * t - t})
    s = g.agg(F.sum("_u").alias("u"), F.sum("_a").alias("n1"), F.sum("_b").alias("n2"), F.sum("_t").alias("_t"))
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.try_divide(F.col("_t"), n * (n - 1))))
    # all values equal: no deviation, nothing speaks against equal groups
    z = F.when(sd > 0, (F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5) / sd).when(sd == 0, F.lit(0.0))
    both = (F.col("n1") > 0) & (F.col("n2") > 0)
    return s.select(F.when(both, F.col("u")).alias("u"), "n1", "n2", (2 * F.try_divide(F.col("u"), F.col("n1") * F.col("n2")) - 1).alias("cliffs_delta"), F.when(both, two_sided(z)).alias("p"))


@F.pandas_udf(DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """Of a normal score; one row a test, as there is no such built-in function."""
    return z.map(lambda v: math.erfc(max(v, 0.0) / math.sqrt(2)), na_action="ignore")
