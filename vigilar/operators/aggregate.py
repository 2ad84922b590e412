"""Counting and summary operators.

``collapse`` is the common first step of every multi-variable table: one pass counts the
distinct combinations of the categorical columns, and the later unpivots work on those
counts instead of on the records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls as nl
from ..functions.formats import percent
from ..functions.levels import Levels
from .reshape import complete_levels


def collapse(df: DataFrame, cols: Sequence[str], n: str = "n", weight: str | None = None) -> DataFrame:
    """Distinct combinations of categorical columns with their row counts."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*cols).agg(size.alias(n))


def patterns_of(df: DataFrame, cols: Sequence[str], n: str, weight: str | None = None) -> DataFrame:
    """Combinations with counts; an input that already carries counts is only projected."""
    cols = list(dict.fromkeys(cols))
    return collapse(df, cols, n) if weight is None else df.select(*cols, F.col(weight).alias(n))


def count_by(df: DataFrame, *keys: str, n: str = "n") -> DataFrame:
    """Group counts; null is a group of its own."""
    return collapse(df, keys, n)


def tested_resistant(long: DataFrame, *keys: str, status: str = "status") -> DataFrame:
    """Number tested and number resistant per group of a long table."""
    return long.groupBy(*keys).agg(
        F.count(status).alias("n_tested"), nl.sum_or_zero(status).cast("long").alias("n_resistant")
    )


def tested_resistant_wide(wide: DataFrame, keys: Sequence[str], statuses: Mapping[str, str],
                          drug: str = "ATB") -> DataFrame:
    """The same from a wide table (``statuses``: column -> drug name).

    Aggregates first and unpivots the few result rows, so records are never multiplied
    by the number of drugs. Groups without a tested record drop out, as they would in the
    long form.
    """
    cells = []
    for column, name in statuses.items():
        cells += [F.count(column).alias(f"t_{name}"), F.sum(column).cast("long").alias(f"r_{name}")]
    agg = wide.groupBy(*keys).agg(*cells)
    packed = F.array(*[
        F.struct(F.lit(name).alias(drug), F.col(f"t_{name}").alias("n_tested"),
                 F.coalesce(F.col(f"r_{name}"), F.lit(0)).alias("n_resistant"))
        for name in statuses.values()
    ])
    return agg.select(*keys, F.inline(packed)).where(F.col("n_tested") > 0)


def column_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Smallest and largest value per column, two rows. All-null columns stay null.

    One global aggregate over the given columns, unpacked afterwards.
    """
    agg = df.agg(*[F.min(c).alias(f"min_{c}") for c in cols], *[F.max(c).alias(f"max_{c}") for c in cols])
    rows = F.array(*[
        F.struct(F.lit(stat).alias("stat"), *[F.col(f"{stat}_{c}").alias(c) for c in cols])
        for stat in ("min", "max")
    ])
    return agg.select(F.inline(rows))


def quartiles(df: DataFrame, column: str, by: Sequence[str] = (),
              probs: Sequence[float] = (0.25, 0.5, 0.75),
              names: Sequence[str] = ("q1", "median", "q3")) -> DataFrame:
    """Exact quantiles with linear interpolation of a measure with few distinct values
    (age in years, diameters in mm).

    Values are counted first, map-side, so a hot group sends one row per distinct value
    and not one per record. For a measure whose distinct values grow with the data use
    :func:`approximate_quartiles`.
    """
    freq = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("__n"))
    arr = F.percentile(F.col(column), F.array(*[F.lit(float(p)) for p in probs]), F.col("__n"))
    out = freq.groupBy(*by).agg(arr.alias("__q")) if by else freq.agg(arr.alias("__q"))
    return out.select(*by, *[F.col("__q")[i].alias(nm) for i, nm in enumerate(names)])


def approximate_quartiles(df: DataFrame, column: str, by: Sequence[str] = (),
                          probs: Sequence[float] = (0.25, 0.5, 0.75), accuracy: int = 100_000,
                          names: Sequence[str] = ("q1", "median", "q3")) -> DataFrame:
    """Quantile sketch of bounded size for continuous measures: rank error 1 / accuracy."""
    arr = F.percentile_approx(column, [float(p) for p in probs], accuracy).alias("__q")
    out = df.groupBy(*by).agg(arr) if by else df.agg(arr)
    return out.select(*by, *[F.col("__q")[i].alias(nm) for i, nm in enumerate(names)])


def missing_by_column(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Null count and percentage per column, optionally per group, in one pass."""
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"__{c}") for c in cols],
    )
    packed = F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"__{c}").alias("n_missing")) for c in cols
    ])
    return agg.select(*by, "n", F.inline(packed)).withColumn("pct_missing", percent("n_missing", "n", 1))


def missing_per_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """How many records have 0, 1, 2, ... of the columns missing."""
    return df.select(nl.null_count(cols).alias("n_missing")).groupBy("n_missing").agg(
        F.count(F.lit(1)).alias("n"))


def co_measured(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """How many records have 0, 1, 2, ... of the columns filled together."""
    return df.select(nl.filled_count(cols).alias("n_filled")).groupBy("n_filled").agg(
        F.count(F.lit(1)).alias("n"))


def missing_patterns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Only a missing, only b missing, both missing; one row."""
    na, nb = F.col(a).isNull(), F.col(b).isNull()
    return df.agg(
        F.count_if(na & ~nb).alias("only_first"),
        F.count_if(~na & nb).alias("only_second"),
        F.count_if(na & nb).alias("both"),
    )


def long_counts(df: DataFrame, variables: Sequence[str], by: Sequence[str] = (),
                weight: str | None = None) -> DataFrame:
    """(by, variable, level, n) for many variables from one pass.

    Rows are unpivoted in the map task and counted there, so the one exchange carries distinct
    levels only, also where combinations of the variables are as many as the rows.
    """
    size = F.lit(1) if weight is None else F.col(weight)
    packed = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables
    ])
    return (
        df.select(*by, size.alias("__n"), F.inline(packed))
        .groupBy(*by, "variable", "level").agg(F.sum("__n").cast("long").alias("n"))
    )


def beside(df: DataFrame, by: Sequence[str], **totals: Column) -> DataFrame:
    """Totals over groups of counted rows (over all rows without ``by``) next to each row.

    An aggregate joined back, or a scalar subquery: map-side combined, so a group of any size
    is no single task's work as it would be in a window. Null keys are a group.
    """
    if not by:
        return df.withColumns({n: df.agg(c.alias(n)).scalar() for n, c in totals.items()})
    sums = df.groupBy(*[F.col(k).alias(f"__by_{k}") for k in by]).agg(*[c.alias(n) for n, c in totals.items()])
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__by_{k}")) for k in by])
    return df.join(sums, on).drop(*[f"__by_{k}" for k in by])


def contingency(df: DataFrame, x: str, y: str, weight: str | None = None,
                x_levels: Sequence | None = None, y_levels: Sequence | None = None) -> DataFrame:
    """Cell counts of x by y over records knowing both; given levels appear even if empty."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    counts = collapse(known, [x, y], "n", weight)
    if x_levels is None or y_levels is None:
        return counts
    return complete_levels(counts, ["n"], **{x: x_levels, y: y_levels})


def freq_table(df: DataFrame, variable: str, na_policy: str = "always",
               levels: Levels | None = None, weight: str | None = None) -> DataFrame:
    """Level counts with a percentage over the known values, rounded to one decimal.

    ``always`` adds a null line even when its count is 0, ``no`` never shows one,
    ``ifany`` shows it when there are null values. Given levels appear even if empty.
    """
    if na_policy not in ("always", "ifany", "no"):
        raise ValueError("na_policy is always, ifany or no")
    counts = collapse(df.select(F.col(variable).cast("string").alias("level"),
                                *([weight] if weight else [])), ["level"], "freq", weight)
    if levels is not None:
        counts = counts.where(F.col("level").isNull() | F.col("level").isin(list(levels.values)))
    spark = df.sparkSession
    extra = []
    if levels is not None:
        extra += [F.lit(v) for v in levels.ordered]
    if na_policy == "always":
        extra.append(F.lit(None).cast("string"))
    if extra:
        scaffold = spark.range(1).select(F.explode(F.array(*extra)).alias("level"),
                                         F.lit(0).cast("long").alias("freq"))
        counts = counts.unionByName(scaffold).groupBy("level").agg(F.sum("freq").alias("freq"))
    if na_policy == "no":
        counts = counts.where(F.col("level").isNotNull())
    counts = beside(counts, [], __known=F.sum(F.when(F.col("level").isNotNull(), F.col("freq"))))
    return counts.select(
        F.lit(variable).alias("variable"), "level", "freq",
        F.when(F.col("level").isNotNull(), percent("freq", "__known", 1)).alias("percent"),
    )


def proportions(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and share of every level, the null level included."""
    counts = collapse(df, [*by, column], "n")
    counts = beside(counts, list(by), __total=F.sum("n"))
    return counts.withColumn("share", nl.ratio("n", "__total")).drop("__total")


def row_total(df: DataFrame, cols: Sequence[str], name: str = "n_R") -> DataFrame:
    return df.withColumn(name, nl.row_sum(cols))


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def distinct_count(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                   approximate: bool = False) -> DataFrame:
    """Records and distinct values per column (nulls not counted as a value)."""
    count = (lambda c: F.approx_count_distinct(c, 0.01)) if approximate else F.countDistinct
    cells = [F.count(F.lit(1)).alias("n_rows")] + [count(c).alias(f"n_{c}") for c in cols]
    return df.groupBy(*by).agg(*cells) if by else df.agg(*cells)
