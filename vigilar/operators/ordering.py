"""Sorting and per-group sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import Levels
from ..sources.tables import cut_lineage, literal_table


def level_order(df: DataFrame, **levels: Levels) -> DataFrame:
    """Sort a result by the order of its level lists, unlisted values last."""
    return df.orderBy(*[lv.rank(c).asc_nulls_last() for c, lv in levels.items()])


def frequency_sort(df: DataFrame, count: str = "n", label: str = "level") -> DataFrame:
    """Most frequent first; ties in label order so the result is stable."""
    return df.orderBy(F.col(count).desc(), F.col(label).asc_nulls_last())


def sample_key(row_id: Column | str, seed: int) -> Column:
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(row_id.cast("string"), F.lit(f"|{seed}")))


def sample_per_group(df: DataFrame, by: Sequence[str], k: int, row_id: str, seed: int = 0) -> DataFrame:
    """``k`` pseudo-random rows per group, the same ones on every run and layout.

    The rank filter lets Spark keep only ``k`` rows per group in each map task before
    the exchange, so a hot group does not land whole in one task.
    """
    order = [sample_key(row_id, seed), F.col(row_id)]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def number_in_order(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Row numbers 1, 2, 3 ... within groups in the order of ``order``, nulls first; equal rows in any order.

    Rows are sorted in ranges of (by, order), so a group of any size is spread over tasks; a small table with one row per
    group and range says how many rows come before. Sorted rows are checkpointed, since ranges are drawn anew by each run.
    """
    keys = [*by, *order]
    placed = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))  # the id is the partition, then the row's place in it
    spans = placed.groupBy(*by, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = spans.select(*[F.col(k).alias(f"__b_{k}") for k in by], F.col("__part").alias("__q"), F.col("__n").alias("__m"))
    same = [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in by]
    starts = spans.join(before, [*same, F.col("__q") < F.col("__part")], "left").groupBy(*by, "__part").agg(
        F.max("__first").alias("__first"), F.coalesce(F.sum("__m"), F.lit(0)).alias("__before"))
    starts = starts.withColumnsRenamed({k: f"__b_{k}" for k in by} | {"__part": "__q"})
    out = placed.join(starts, [*same, F.col("__q") == F.col("__part")])
    return out.withColumn(name, F.col("__at") - F.col("__first") + F.col("__before") + 1).select(*df.columns, name)


def report_template(spark, grids: dict[str, Sequence[str]]) -> DataFrame:
    """Row set of a report: every (variable, level) of the level lists, with its rank.

    Taken from the lists, so it does not depend on which subgroup filled most levels.
    """
    rows = [(v, i + 1, lv) for v, levels in grids.items() for i, lv in enumerate(levels)]
    return literal_table(spark, rows, "variable string, level_rank int, level string")
