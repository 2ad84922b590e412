"""Presentation text. Percentages are rounded half to even in decimal arithmetic,
so the printed digit never depends on floating-point noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col


def decimal_percent(n: Column | str, total: Column | str, digits: int) -> Column:
    """100 * n / total rounded half to even in decimal arithmetic; null when the total is
    null or 0. Sixteen decimals are carried before rounding."""
    num = col(n).cast("decimal(18,0)") * F.lit(100).cast("decimal(3,0)")
    den = F.nullif(col(total).cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    return F.bround(num / den, digits)


def percent(n: Column | str, total: Column | str, digits: int = 1) -> Column:
    return decimal_percent(n, total, digits).cast("double")


def trim_zeros(text: Column) -> Column:
    """"50.0" -> "50", "12.50" -> "12.5"."""
    return F.regexp_replace(text, r"\.0+$|(\.\d*?[1-9])0+$", "$1")


def percent_text(n: Column | str, total: Column | str, digits: int = 1) -> Column:
    return trim_zeros(decimal_percent(n, total, digits).cast("string"))


def number_text(c: Column | str, digits: int) -> Column:
    """Rounded half to even, without trailing zeros."""
    value = F.bround(col(c), digits)
    return F.when(value.isNotNull(), trim_zeros(F.format_string(f"%.{digits}f", value)))


def format_n_pct(n: Column | str, total: Column | str, digits: int = 1) -> Column:
    """``12 (34.5)``; only the count when there is no percentage."""
    share = F.concat(F.lit(" ("), percent_text(n, total, digits), F.lit(")"))
    return F.concat(col(n).cast("string"), F.coalesce(share, F.lit("")))


def format_ci(value: Column | str, low: Column | str, high: Column | str, digits: int = 2,
              sep: str = " - ") -> Column:
    """``1.5 (0.9 - 2.4)``; a missing limit prints as NA, a missing value gives null."""
    parts = [F.coalesce(number_text(c, digits), F.lit("NA")) for c in (low, high)]
    value = number_text(value, digits)
    return F.concat(value, F.lit(" ("), parts[0], F.lit(sep), parts[1], F.lit(")"))


def format_p(c: Column | str, bound: float | None = None) -> Column:
    """Three decimals; ``<0.001`` when they round to 0, or up to ``bound`` where a table sets one. Null stays null."""
    p = col(c)
    small = F.bround(p, 3) == 0 if bound is None else p <= bound
    return F.when(small, F.lit("<0.001")).when(p.isNotNull(), number_text(p, 3))
