"""Window columns over aggregated tables.

Windows run on results of a group-by (a few rows per partition value). On record-level
tables a group size is an aggregate joined back with :func:`group_size`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nulls as nl
from .joins import HOT_ROWS, attach_by_key


def partition_total(df: DataFrame, value: str, by: Sequence[str], name: str = "tot") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by)))


def share(df: DataFrame, value: str, by: Sequence[str], name: str = "share") -> DataFrame:
    return df.withColumn(name, nl.ratio(F.col(value), F.sum(value).over(Window.partitionBy(*by))))


def running_total(df: DataFrame, value: Column | str, by: Sequence[str],
                  order: Sequence[Column | str], name: str = "cum") -> DataFrame:
    """Running sum in the given order, rows with a null order value last."""
    keys = [nl.col(c).asc_nulls_last() for c in order]
    frame = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(nl.col(value)).over(frame))


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column | str],
                name: str = "nr") -> DataFrame:
    keys = [nl.col(c).asc_nulls_last() for c in order]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))


def next_value(df: DataFrame, value: str, by: Sequence[str], order: Sequence[Column | str],
               name: str) -> DataFrame:
    """Value of the following row of the block."""
    keys = [nl.col(c).asc_nulls_last() for c in order]
    return df.withColumn(name, F.lead(value).over(Window.partitionBy(*by).orderBy(*keys)))


def blank_repeats(df: DataFrame, label: str, by: Sequence[str], order: Sequence[Column | str],
                  name: str | None = None) -> DataFrame:
    """Show the label on the first line of each block only."""
    keys = [nl.col(c).asc_nulls_last() for c in order]
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*keys)) == 1
    return df.withColumn(name or label, F.when(first, F.col(label)))


def flag_maximum(df: DataFrame, value: str, by: Sequence[str], name: str = "is_max") -> DataFrame:
    """Mark the row or rows holding the largest value of their group of result rows."""
    return df.withColumn(name, F.col(value) == F.max(value).over(Window.partitionBy(*by)))


def group_size(df: DataFrame, keys: Sequence[str], row_id: str, name: str = "n_group",
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows per key beside each row, without a window over the records.

    Counts are combined map-side first, then joined back with hot keys salted. Rows with
    a null key get null.
    """
    known = df.na.drop(subset=list(keys))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return attach_by_key(df, sizes, keys, name, row_id, hot_rows)
