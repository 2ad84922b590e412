"""Resistance prevalence, by level, by year and as a drug grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nulls as nl
from ..functions.formats import number_text, percent
from ..functions.special import exact_limits
from .aggregate import patterns_of
from .columns import case_when
from .reshape import map_values, to_wide


def with_exact_interval(df: DataFrame, resistant: str = "n_resistant", tested: str = "n_tested") -> DataFrame:
    """Percentage resistant with its exact 95 % limits, all in percent."""
    ci = exact_limits(resistant, tested)
    return (
        df.withColumn("__ci", ci)
        .withColumns({
            "perc": F.lit(100.0) * nl.ratio(resistant, tested),
            "ci_low": F.lit(100.0) * F.nanvl(F.col("__ci.low"), F.lit(None).cast("double")),
            "ci_high": F.lit(100.0) * F.nanvl(F.col("__ci.high"), F.lit(None).cast("double")),
        }).drop("__ci")
    )


def level_counts(df: DataFrame, variables: Sequence[str], status: str,
                 weight: str | None = None) -> DataFrame:
    """(variable, level, n_tested, n_resistant) for known levels of all variables, one pass."""
    patterns = patterns_of(df, [status, *variables], "__n", weight)
    packed = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables])
    event = F.when(F.col("__status") == 1, F.col("__n")).otherwise(0)
    return (
        patterns.select("__n", F.col(status).alias("__status"), F.inline(packed))
        .where(F.col("level").isNotNull())
        .groupBy("variable", "level")
        .agg(F.sum("__n").alias("n_tested"), F.sum(event).alias("n_resistant"))
    )


def prevalence(df: DataFrame, variables: Sequence[str], status: str = "status",
               weight: str | None = None) -> DataFrame:
    """Per level: tested, resistant, percentage and exact interval rounded to two decimals."""
    out = with_exact_interval(level_counts(df, variables, status, weight))
    return out.withColumns({c: F.bround(c, 2) for c in ("perc", "ci_low", "ci_high")})


def prevalence_matrix(counts: DataFrame, by: Sequence[str], species: str, species_values: Sequence[str],
                      drug: str, drugs: Sequence[str]) -> DataFrame:
    """``n, p (l;u)`` text by species columns, drugs in list order, others dropped.

    ``counts`` is a tested/resistant table keyed by (by, species, drug).
    """
    order = F.array_position(F.array(*[F.lit(d) for d in drugs]), F.col(drug))
    ci = with_exact_interval(counts.where(F.col(drug).isin(list(drugs))))
    text = F.concat(F.col("n_tested").cast("string"), F.lit(", "), number_text("perc", 2), F.lit(" ("),
                    number_text("ci_low", 2), F.lit(";"), number_text("ci_high", 2), F.lit(")"))
    cells = ci.withColumn("__text", text)
    return (
        to_wide(cells, [*by, drug], species, species_values, "__text")
        .withColumn("drug_rank", order)
        .orderBy(*by, "drug_rank")
    )


def yearly_resistance(counts: DataFrame, year: str, species: str, by: Sequence[str] = (),
                      keep_zero: bool = False) -> DataFrame:
    """Share of each species' resistant records among all tested that year.

    ``counts`` is a tested/resistant table keyed by (by, year, species). Adds the yearly
    resistant share and the running share in species order, null species last. Species
    without a resistant record are left out unless ``keep_zero``.
    """
    year_of = Window.partitionBy(*by, year)
    running = year_of.orderBy(F.col(species).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.select(
        *by, year, species, F.col("n_resistant").alias("n"),
        F.sum("n_tested").over(year_of).alias("tot"),
        F.sum("n_resistant").over(year_of).alias("n_r"),
        F.sum("n_resistant").over(running).alias("__cum"))
    out = out.withColumns({
        "sp_perc_resist": nl.ratio("n", "tot"), "yr_perc_resist": nl.ratio("n_r", "tot"),
        "cum_perc_resist": nl.ratio("__cum", "tot")}).drop("__cum")
    return out if keep_zero else out.where(F.col("n") > 0)


def yearly_rate(counts: DataFrame) -> DataFrame:
    """Resistant share of a tested/resistant table; years without a resistant record stay, as 0."""
    return counts.withColumn("rate", nl.ratio("n_resistant", "n_tested"))


def yearly_line(counts: pd.DataFrame) -> pd.DataFrame:
    """One group's least-squares line of the yearly percentage resistant: years, slope a year, share explained, year of the
    highest percentage. For ``group_function`` over a tested/resistant table keyed by (ATB, year_real)."""
    year, share = counts["year_real"].to_numpy(float), 100.0 * counts["n_resistant"].to_numpy(float) / counts["n_tested"].to_numpy(float)
    x, y = year - year.mean(), share - share.mean()
    spread, gain = x @ x, x @ y
    slope = gain / spread if spread > 0 else np.nan
    r2 = np.nan if spread == 0 else 1.0 if y @ y == 0 else slope * gain / (y @ y)
    return pd.DataFrame({"ATB": counts["ATB"].iloc[:1].to_numpy(), "n_years": [len(counts)], "slope": [slope], "r2": [r2],
                         "peak": [int(year[np.lexsort((year, -share))[0]])]})


def grid_bin(perc: Column | str, bins: Sequence[tuple[str, int, int]]) -> Column:
    """Label of the bin holding the percentage; lower edges belong to the bin, and so does
    the last upper edge."""
    p = nl.col(perc)
    last = bins[-1][0]
    return case_when(*[
        ((p >= lo) & ((p <= hi) if label == last else (p < hi)), label) for label, lo, hi in bins])


def resistance_grid(counts: DataFrame, species: str, drug: str, drugs: Sequence[str],
                    display: Mapping[str, str], bins: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Resistant / tested per drug and species with its percentage bin and display name.

    Groups without a resistant record stay with 0; records without a species are left out.
    """
    order = F.array_position(F.array(*[F.lit(d) for d in drugs]), F.col(drug))
    kept = counts.where(F.col(species).isNotNull() & F.col(drug).isin(list(drugs)))
    share = F.lit(100.0) * nl.ratio("n_resistant", "n_tested")
    return kept.withColumns({
        "drug_rank": order, "drug_name": map_values(display, drug),
        "value": percent("n_resistant", "n_tested", 1), "value_bin": share < 50,
        "value_cut": grid_bin(share, bins)})


def fully_susceptible(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Records without any resistance per group, with the group total and percentage.

    One aggregate: groups without such a record keep a 0, no join is needed for them.
    """
    none = nl.row_sum(cols) == 0
    out = df.groupBy(*keys).agg(F.count_if(none).alias("n_susceptible"), F.count(F.lit(1)).alias("tot"))
    return out.withColumn("perc", percent("n_susceptible", "tot", 2))


def resistance_count_distribution(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """How many records are resistant to 0, 1, 2, ... drugs."""
    return df.select(*keys, nl.row_sum(cols).alias("n_R")).groupBy(*keys, "n_R").agg(
        F.count(F.lit(1)).alias("n"))
