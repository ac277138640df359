"""Rounding and text-to-number rules shared by figures and scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal notation accepted as a number when it arrives as text.
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def fixed(x: Column, digits: int) -> Column:
    """Round half away from zero to ``digits`` decimals; null and non-finite give null."""
    k = 10**digits
    scaled = F.floor(F.abs(x) * k + F.lit(0.5)) / F.lit(float(k))
    return F.when(is_finite(x), F.signum(x) * scaled + F.lit(0.0))


def round_int(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def sig3(x: Column) -> Column:
    """Three significant digits."""
    return F.format_string("%.3g", x).try_cast("double")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def text_number(s: Column, pattern: str = NUMBER_TEXT) -> Column:
    """A finite number written as text, otherwise null."""
    trimmed = F.trim(s)
    n = trimmed.try_cast("double")
    return F.when(trimmed.rlike(pattern) & is_finite(n), n)


def close(a: Column, b: Column, rel: float = 0.01, floor: float = 0.0015) -> Column:
    """Whether two numbers agree within a relative tolerance (never tighter than ``floor``)."""
    near = F.abs(a - b) <= F.greatest(F.lit(float(floor)), F.lit(float(rel)) * F.abs(b))
    return F.coalesce(near, F.lit(False))


def share(part: Column, whole: Column) -> Column:
    """part / whole, null when there is no whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
