"""Minimum inhibitory concentration tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import beside, collapse


def mic_joint(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Number of isolates per pair of MIC values."""
    return collapse(df, [a, b], "n_same_combination", weight)


def mic_distribution(df: DataFrame, column: str, levels: Sequence[str],
                     weight: str | None = None) -> DataFrame:
    """Isolates per MIC level, every level shown, with the number tested.

    Values outside the level list stay in the tested total but have no line.
    """
    value = F.col(column).cast("string").alias("level")
    counts = collapse(df.select(value, *([weight] if weight else [])), ["level"], "n_isolates", weight)
    grid = df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(v) for v in levels])).alias("level_rank", "level"))
    stacked = counts.select("level", "n_isolates").unionByName(
        grid.select("level", F.lit(0).cast("long").alias("n_isolates")))
    merged = stacked.groupBy("level").agg(F.sum("n_isolates").alias("n_isolates"))
    ranks = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col("level"))
    return (
        beside(merged, [], n_tested=F.sum("n_isolates")).withColumn("level_rank", ranks)
        .where(F.col("level_rank") > 0).select("level_rank", "level", "n_isolates", "n_tested")
    )


def resistant_total(df: DataFrame, status: str) -> DataFrame:
    """Number resistant over the whole table, null counted as 0."""
    return df.agg(F.coalesce(F.sum(status), F.lit(0)).alias("n_resistant"))
