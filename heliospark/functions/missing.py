"""Null is the only missing value: fills, NaN and infinities become null where data enter, and stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fill thresholds of the instruments' products.
FLUX_FILL = -1e30
FIELD_FILL, FIELD_LIMIT = 9999.0, 1e20
REFERENCE_FILLS = {"field": 9999.0, "speed": 99999.0, "density": 999.0, "temperature": 9999999.0}
QUALITY_GOOD = 0.5
TRUE_TEXTS = ("true", "1")


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean_flux(x: Column, positive: bool = False) -> Column:
    """Null for non-finite values, fills and, on demand, what isn't positive."""
    ok = finite(x) > FLUX_FILL
    return F.when(ok & (x > 0) if positive else ok, x)


def clean_field(x: Column) -> Column:
    return F.when((F.abs(finite(x)) < FIELD_FILL) & (F.abs(x) <= FIELD_LIMIT), x)


def clean_reference(x: Column, kind: str) -> Column:
    """Null for fills: of a field on both sides, of other kinds large values alone."""
    size = F.abs(finite(x)) if kind == "field" else finite(x)
    return F.when(size < REFERENCE_FILLS[kind], x)


def gate(flag: Column, x: Column) -> Column:
    """x where the quality flag is good; a null flag is bad."""
    return F.when(F.coalesce(flag, F.lit(0.0)) >= QUALITY_GOOD, x)


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null if that isn't finite or is negative."""
    r = F.try_divide(a, b)
    return F.when(r >= 0, finite(r))


def clip_low(x: Column) -> Column:
    """max(x, 0) that keeps null."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def row_mean(*xs: Column) -> Column:
    """Mean of the values that are there."""
    return F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)), _there(*xs))


def row_median(*xs: Column) -> Column:
    """Median of the values that are there. Sorted, nulls are first; without a value the row's last place is asked, which is null."""
    s, n = F.sort_array(F.array(*xs)), _there(*xs)
    at = lambda up: F.get(s, (len(xs) - n + F.floor(up / 2)).cast("int"))
    return (at(n - 1) + at(n)) / 2


def _there(*xs: Column) -> Column:
    return sum((x.isNotNull().cast("int") for x in xs), F.lit(0))


def truth(text: Column, true: tuple[str, ...] = TRUE_TEXTS) -> Column:
    """Booleans from text; anything else, and null, is false."""
    return F.coalesce(F.lower(F.trim(text)).isin(*true), F.lit(False))


def share_there(*xs: Column) -> Column:
    return sum((x.isNotNull().cast("double") for x in xs), F.lit(0.0)) / len(xs)


def all_there(*xs: Column) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & x.isNotNull()
    return out


def supplied_else(supplied: Column, computed: Column) -> Column:
    """The supplied text as a boolean, even if it can't be read; the computed value only where none is supplied."""
    return F.when(supplied.isNull(), computed).otherwise(truth(supplied))
