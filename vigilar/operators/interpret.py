"""From inhibition diameters to susceptible / resistant calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls as nl
from .columns import recode
from .joins import one_row_per_key


def _call(matched: Column, threshold: Column, diameter: Column, recorded: Column) -> Column:
    """Null threshold voids the call; a known diameter decides, strictly below is R; else the
    recorded call stays. Without a threshold row the recorded call stays."""
    decided = F.when(diameter < threshold, F.lit("R")).otherwise(F.lit("S"))
    return (
        F.when(~matched, recorded)
        .when(threshold.isNull(), F.lit(None).cast("string"))
        .when(diameter.isNotNull(), decided)
        .otherwise(recorded)
    )


def interpret(long: DataFrame, breakpoints: DataFrame, drug: str = "ATB", year: str = "year",
              diameter: str = "diam", recorded: str = "SIR", drop_null_year: bool = False) -> DataFrame:
    """Long form: one row per record and drug, joined to its (drug, year) threshold."""
    if drop_null_year:
        long = long.where(F.col(year).isNotNull())
    cuts = one_row_per_key(breakpoints.select("ATB", "annee", "seuil"), ["ATB", "annee"]).select(
        F.col("ATB").alias("__drug"), F.col("annee").alias("__year"), F.col("seuil").alias("__cut"),
        F.lit(True).alias("__matched"))
    joined = long.join(cuts, (F.col(drug) == F.col("__drug")) & (F.col(year) == F.col("__year")), "left")
    call = _call(F.coalesce(F.col("__matched"), F.lit(False)), F.col("__cut"), F.col(diameter),
                 F.col(recorded))
    return joined.withColumn(recorded, call).drop("__drug", "__year", "__cut", "__matched")


def interpret_wide(wide: DataFrame, breakpoints: DataFrame, drugs: Sequence[str], year: str = "year",
                   drop_null_year: bool = False) -> DataFrame:
    """Wide form: the thresholds become one row per year and meet the records in a single
    join on the year, so records are never multiplied by the number of drugs."""
    if drop_null_year:
        wide = wide.where(F.col(year).isNotNull())
    cuts = one_row_per_key(breakpoints.select("ATB", "annee", "seuil"), ["ATB", "annee"])
    cells = []
    for d in drugs:
        mine = F.col("ATB") == F.lit(d)
        cells += [F.max(F.when(mine, F.col("seuil"))).alias(f"__cut_{d}"),
                  (F.count_if(mine) > 0).alias(f"__has_{d}")]
    by_year = cuts.groupBy(F.col("annee").alias("__year")).agg(*cells)
    joined = wide.join(by_year, F.col(year) == F.col("__year"), "left")
    calls = {
        f"{d}_SIR": _call(F.coalesce(F.col(f"__has_{d}"), F.lit(False)), F.col(f"__cut_{d}"),
                          F.col(f"{d}_d"), F.col(f"{d}_SIR"))
        for d in drugs
    }
    return joined.withColumns(calls).select(*wide.columns)


def harmonise_call(c: Column | str) -> Column:
    """Upper case; I counts as R, S* as S; any other text is unknown."""
    return recode(F.upper(nl.col(c)), {"S": "S", "S*": "S", "R": "R", "I": "R"}, default=None)


def harmonise_calls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: harmonise_call(c) for c in cols})


def binary_call(c: Column | str) -> Column:
    return recode(nl.col(c), {"S": 0, "R": 1}, default=None).cast("int")


def binary_status(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: binary_call(c) for c in cols})
