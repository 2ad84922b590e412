"""Row filters. Conditions stay plain so the scan can take them over."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame

from ..functions import nulls as nl


def keep(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows where every condition is true; a null condition drops the row."""
    for cond in conditions:
        df = df.where(cond)
    return df



def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def regex_filter(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(nl.detects(column, pattern))


def any_equal(cols: Sequence[str], value) -> Column:
    """True when at least one column equals the value; nulls count as no."""
    return reduce(or_, [nl.same(c, value) for c in cols])


def any_of(df: DataFrame, cols: Sequence[str], value) -> DataFrame:
    return df.where(any_equal(cols, value))
