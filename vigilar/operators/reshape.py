"""Wide/long reshaping, stacking and level grids."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nulls as nl


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], key: str = "ATB",
            value: str = "status", keep_null: bool = True) -> DataFrame:
    """Wide to (key, value)."""
    out = df.unpivot(list(ids), list(values), key, value)
    return out if keep_null else out.where(F.col(value).isNotNull())


def to_wide(df: DataFrame, ids: Sequence[str], key: str, values: Sequence[str], value: str,
            missing=None, prefix: str = "") -> DataFrame:
    """(key, value) to columns.

    The key values are given, so no extra pass looks for them, and each cell is a
    conditional aggregate: one exchange on ``ids``, with map-side combining.
    """
    cells = [
        F.first(F.when(F.col(key) == F.lit(v), F.col(value)), ignorenulls=True).alias(f"{prefix}{v}")
        for v in values
    ]
    out = df.groupBy(*ids).agg(*cells)
    if missing is None:
        return out
    return out.withColumns({f"{prefix}{v}": F.coalesce(F.col(f"{prefix}{v}"), F.lit(missing))
                            for v in values})


def union_tables(*tables: DataFrame) -> DataFrame:
    """Stack by column name; a column one table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def level_grid(spark, **levels: Sequence) -> DataFrame:
    """All combinations of short, given level lists (built from literals, not from data)."""
    out = spark.range(1).select()
    for name, values in levels.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def complete_levels(df: DataFrame, counts: Sequence[str], by: Sequence[str] = (),
                    **levels: Sequence) -> DataFrame:
    """Keep empty categories: every level combination appears, counts filled with 0.

    ``by`` adds the group values present in the aggregated input. The levels ride along
    as an array literal per group, so nothing is paired with anything but given levels.
    """
    names = list(levels)
    grid = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    for name, values in levels.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    keys = [*by, *names]
    right = df.select(*keys, *[c for c in df.columns if c not in keys]).withColumnsRenamed(
        {k: f"__{k}" for k in keys}
    )
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return (
        grid.join(right, on, "left").drop(*[f"__{k}" for k in keys])
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    )


def group_function(counts: DataFrame, keys: Sequence[str],
                   fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One pandas function per group of an aggregated table (few rows per group)."""
    return counts.groupBy(*keys).applyInPandas(fn, schema)


def map_values(names: Mapping[str, str], column: str):
    """Value map as a literal lookup: unmatched values stay."""
    return F.coalesce(nl.lookup(column, names), F.col(column))
