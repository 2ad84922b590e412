"""Missing-value rules that differ from plain SQL.

Every helper returns a Column built from JVM expressions, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else(cond: Column, yes, no) -> Column:
    """Null condition gives null; SQL CASE would take the ELSE branch."""
    return F.when(cond, yes).when(~cond, no)


def in_set(c: Column | str, values) -> Column:
    """Membership that is never null."""
    values = list(values)
    if not values:
        return F.lit(False)
    return F.coalesce(col(c).isin(values), F.lit(False))


def same(c: Column | str, value) -> Column:
    """Equality that is never null."""
    return col(c).eqNullSafe(F.lit(value))


def matches(c: Column | str, pattern: str) -> Column:
    """Regex test that treats null text as no match."""
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def detects(c: Column | str, pattern: str) -> Column:
    """Regex test that keeps null for null text."""
    return col(c).rlike(pattern)


def extract(c: Column | str, pattern: str) -> Column:
    """First match of ``pattern`` or null (Spark alone gives an empty string)."""
    return F.nullif(F.regexp_extract(col(c), f"({pattern})", 1), F.lit(""))


def any_positive(cols) -> Column:
    """1 if any 0/1 column is 1, 0 if the known ones are all 0, null if none is known."""
    cols = [col(c) for c in cols]
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def row_sum(cols) -> Column:
    """Sum across columns, null counted as 0."""
    return reduce(add, [F.coalesce(col(c), F.lit(0)) for c in cols])


def null_count(cols) -> Column:
    """Number of null columns in the row."""
    return reduce(add, [col(c).isNull().cast("int") for c in cols])


def filled_count(cols) -> Column:
    """Number of non-null columns in the row."""
    return reduce(add, [col(c).isNotNull().cast("int") for c in cols])


def sum_or_zero(c: Column | str) -> Column:
    """Aggregate sum; an all-null group gives 0."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Double division; a zero denominator gives null instead of an ANSI error."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def number(c: Column | str) -> Column:
    """Text to double; unreadable text gives null. A decimal comma is accepted."""
    return F.replace(F.trim(col(c).cast("string")), F.lit(","), F.lit(".")).try_cast("double")


def lookup(c: Column | str, mapping) -> Column:
    """Value of a small given map, null when the key is not in it.

    The map is a literal, so the generated code stays short however many entries it has;
    long CASE chains push a stage past the size the JVM compiles.
    """
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(c))
