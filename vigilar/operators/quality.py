"""Checks that list or count suspicious values instead of changing them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import long_counts


def date_incoherence(df: DataFrame, sampled: str, received: str) -> DataFrame:
    """Records received before their sampling year, or more than a year after it."""
    gap = F.year(received) - F.year(sampled)
    return df.withColumn("diff_date", gap).where((F.col("diff_date") > 1) | (F.col("diff_date") < 0))


def out_of_range(df: DataFrame, cols: Sequence[str], low: float, high: float) -> DataFrame:
    """Count of values outside [low, high] per column, zeros counted apart; one pass."""
    cells = []
    for c in cols:
        v = F.col(c)
        cells.append(F.struct(
            F.lit(c).alias("variable"), F.count_if(v == 0).alias("n_zero"),
            F.count_if(v < low).alias("n_low"), F.count_if(v > high).alias("n_high")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def rows_out_of_range(df: DataFrame, cols: Sequence[str], low: float, high: float) -> DataFrame:
    return df.where(reduce(or_, [~F.col(c).between(low, high) for c in cols]))


def value_census(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts per value over many columns at once."""
    return long_counts(df, cols)
