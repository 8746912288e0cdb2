"""Spectra as arrays of doubles over a shared grid; null is a missing bin."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BINS, LOWEST, HIGHEST = 64, 320.0, 2100.0
MIN_SHARED = 16


def energy_grid() -> list[float]:
    step = (math.log(HIGHEST) - math.log(LOWEST)) / (BINS - 1)
    return [math.exp(math.log(LOWEST) + i * step) for i in range(BINS)]


def grid_column(values: list[float] | None = None) -> Column:
    return F.array(*[F.lit(v) for v in values or energy_grid()])


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def probabilities(flux: Column, least: int = MIN_SHARED) -> Column:
    """Shares of the positive bins' sum; null if there are too few. Missing bins stay missing."""
    clean = F.transform(flux, lambda x: F.when(x > 0, x))
    there = F.filter(clean, lambda x: x.isNotNull())
    return F.when((F.size(there) >= least) & (total(there) > 0), let(total(there), lambda t: F.transform(clean, lambda x: x / t)))


def shared(p: Column, q: Column, grid: Column) -> Column:
    """Bins (p, q, x) that both have, in grid order."""
    bins = F.zip_with(F.arrays_zip(p.alias("p"), q.alias("q")), grid, lambda b, x: F.struct(b["p"].alias("p"), b["q"].alias("q"), x.alias("x")))
    return F.filter(bins, lambda b: b["p"].isNotNull() & b["q"].isNotNull())


def _renormalised(bins: Column, body) -> Column:
    """body of the bins as shares of their sums; sums and shares are computed once."""
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    sums = F.aggregate(bins, start, lambda s, b: F.struct((s["p"] + b["p"]).alias("p"), (s["q"] + b["q"]).alias("q")))
    return let(sums, lambda s: let(F.transform(bins, lambda b: F.struct(F.try_divide(b["p"], s["p"]).alias("p"), F.try_divide(b["q"], s["q"]).alias("q"), b["x"].alias("x"))), body))


def _js(bs: Column) -> Column:
    def part(a, m):
        return F.when(a > 0, a * F.ln(a / m)).otherwise(F.lit(0.0))

    both = lambda b: let((b["p"] + b["q"]) / 2, lambda m: 0.5 * part(b["p"], m) + 0.5 * part(b["q"], m))
    return F.aggregate(bs, F.lit(0.0), lambda s, b: s + both(b))


def _hellinger(bs: Column) -> Column:
    return F.sqrt(0.5 * F.aggregate(bs, F.lit(0.0), lambda s, b: s + F.pow(F.sqrt(b["p"]) - F.sqrt(b["q"]), 2)))


def jensen_shannon(bins: Column) -> Column:
    """Divergence, natural logarithm; 0 log 0 is 0."""
    return F.when(F.size(bins) > 0, _renormalised(bins, _js))


def hellinger(bins: Column) -> Column:
    return F.when(F.size(bins) > 0, _renormalised(bins, _hellinger))


def _wasserstein(bs: Column) -> Column:
    """Of cumulative shares over log energy, scaled to 0..1 on the shared bins; each bin weighs the step that leads to it."""

    ends = F.struct(F.ln(F.get(bs, F.lit(0))["x"]).alias("first"), (F.ln(F.get(bs, F.size(bs) - 1)["x"]) - F.ln(F.get(bs, F.lit(0))["x"])).alias("span"))

    def walk(bs: Column, first: Column, span: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("gap"), F.lit(None).cast("double").alias("at"), F.lit(0.0).alias("sum"))

        def step(s, b):
            gap, at = s["gap"] + b["p"] - b["q"], (F.ln(b["x"]) - first) / span
            return F.struct(gap.alias("gap"), at.alias("at"), (s["sum"] + F.abs(gap) * F.coalesce(at - s["at"], F.lit(0.0))).alias("sum"))

        return F.aggregate(bs, start, step, lambda s: s["sum"])

    return let(ends, lambda e: walk(bs, e["first"], e["span"]))


def wasserstein(bins: Column) -> Column:
    return F.when(F.size(bins) >= 2, _renormalised(bins, _wasserstein))


def divergences(p: Column, q: Column, grid: Column, least: int = MIN_SHARED) -> Column:
    """js, hellinger and wasserstein, all null unless enough bins are shared."""
    parts = lambda bs: F.struct(_js(bs).alias("js"), _hellinger(bs).alias("hellinger"), _wasserstein(bs).alias("wasserstein"))
    return let(shared(p, q, grid), lambda b: F.when(F.size(b) >= least, _renormalised(b, parts)))


def shape(p: Column, q: Column, grid: Column) -> Column:
    """Eleven shape values of two complete spectra; null if any bin of either is missing."""
    complete = ~F.exists(p, lambda x: x.isNull()) & ~F.exists(q, lambda x: x.isNull()) & (total(p) > 0) & (total(q) > 0)

    def unit(a):
        return let(total(a), lambda t: F.transform(a, lambda x: x / t))

    def values(a, b):
        cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))))
        c1, c2 = dot(a, grid), dot(b, grid)
        peak = lambda s: F.element_at(grid, F.array_position(s, F.array_max(s)).cast("int"))
        width = lambda s: let(dot(s, grid), lambda c: F.sqrt(total(F.zip_with(s, grid, lambda x, e: x * (e - c) * (e - c)))))
        names = {"cosine": cosine, "angle": F.acos(cosine), "centroid1": c1, "centroid2": c2, "centroid_delta": c1 - c2, "width1": width(a), "width2": width(b), "width_delta": width(a) - width(b), "peak1": peak(a), "peak2": peak(b), "log_peak_ratio": F.ln(peak(a) / peak(b))}
        return F.struct(*[v.alias(k) for k, v in names.items()])

    return F.when(complete, let(F.struct(unit(p).alias("a"), unit(q).alias("b")), lambda s: values(s["a"], s["b"])))


def regrid(points: Column, grid: list[float], least: int) -> Column:
    """Log-log interpolation of (e, f) points onto a grid, inside their range alone; null with too few valid points. Of equal energies the first counts.

    One walk over the sorted points and the grid: the points' logarithms are taken once, and each grid value looks at its two neighbours.
    """
    logs = F.transform(F.filter(points, lambda b: (b["e"] > 0) & (b["f"] > 0)), lambda b, i: F.struct(F.ln(b["e"]).alias("e"), i.alias("i"), F.ln(b["f"]).alias("f")))

    def single(s: Column) -> Column:
        return F.filter(s, lambda b, i: F.coalesce(F.get(s, i - 1)["e"] < b["e"], F.lit(True)))

    def walk(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("k"), F.array().cast("array<double>").alias("out"))

        def step(a, g):
            # from where the last grid value stood on: the first point not below this one
            ahead = lambda k: F.coalesce(F.array_position(F.transform(F.slice(s, k + 1, F.size(s)), lambda b: b["e"] >= g), True).cast("int") - 1 + k, F.lit(-1))
            return let(ahead(a["k"]), lambda k: F.struct(F.greatest(k, a["k"]).alias("k"), F.concat(a["out"], F.array(between(s, k, a["k"], g))).alias("out")))

        def between(s, k, last, g):
            high, low = F.get(s, k), F.get(s, k - 1)
            w = (g - low["e"]) / (high["e"] - low["e"])
            return F.when(k < last, F.lit(None)).when(high["e"] == g, F.exp(high["f"])).when(k > 0, F.exp(low["f"] + w * (high["f"] - low["f"])))

        return F.aggregate(F.array(*[F.lit(math.log(g)) for g in grid]), start, step, lambda a: a["out"])

    return let(F.array_sort(logs), lambda s: F.when(F.size(s) >= least, let(single(s), lambda b: F.when(F.size(b) >= least, walk(b)))))
