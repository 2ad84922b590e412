"""Association and trend tests on contingency counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nulls as nl
from ..functions.levels import Levels
from ..functions.special import chi2_sf
from ..sources.tables import cut_lineage
from .aggregate import beside, collapse, contingency, patterns_of
from .exact import exact_p

PEARSON, CORRECTED, FISHER = "chisq", "chisq corr", "fisher"


def chi_square(df: DataFrame, x: str, y: str, yates: bool = False, by: Sequence[str] = (),
               weight: str | None = None) -> DataFrame:
    """Pearson test of x by y: n, df, min_expected, statistic, p_value (per group of ``by``).

    Empty cells need no grid: they add their expected counts, which sum to n minus the
    expected counts of the filled cells. The correction applies to 2 x 2 tables only.
    """
    cells = (contingency(df, x, y, weight) if not by else
             collapse(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), [*by, x, y], "n", weight))
    return _pearson(cells, x, y, yates, by)


def _pearson(cells: DataFrame, x: str, y: str, yates: bool, by: Sequence[str]) -> DataFrame:
    one = F.count(F.lit(1))
    cells = beside(cells, [*by, x], __r=F.sum("n"), __fx=1.0 / one)
    cells = beside(cells, [*by, y], __c=F.sum("n"), __fy=1.0 / one)
    cells = beside(cells, list(by), __t=F.sum("n"))
    # dividing before multiplying keeps products of large margins within doubles
    cells = cells.withColumn("__e", F.col("__r").cast("double") / F.col("__t") * F.col("__c"))
    gap = F.abs(F.col("n") - F.col("__e"))
    out = cells.groupBy(*by).agg(
        F.max("__t").alias("n"),
        F.round(F.sum("__fx")).cast("int").alias("n_x"), F.round(F.sum("__fy")).cast("int").alias("n_y"),
        (F.min("__r") / F.max("__t") * F.min("__c")).alias("min_expected"),
        F.sum(gap * gap / F.col("__e")).alias("__filled"), F.sum("__e").alias("__seen"),
        F.count(F.lit(1)).alias("__cells"), F.max(gap).alias("__gap"),
        F.sum(F.col("__fx") / F.col("__r")).alias("__ir"), F.sum(F.col("__fy") / F.col("__c")).alias("__ic"),
    )
    empty = F.when(F.col("__cells") < F.col("n_x") * F.col("n_y"), F.col("n") - F.col("__seen")).otherwise(0.0)
    plain = F.col("__filled") + empty
    shrunk = F.col("__gap") - F.least(F.lit(0.5), F.col("__gap"))
    corrected = shrunk * shrunk * F.col("n") * F.col("__ir") * F.col("__ic")
    square = (F.col("n_x") == 2) & (F.col("n_y") == 2)
    stat = F.when(square, corrected).otherwise(plain) if yates else plain
    out = out.withColumn("df", (F.col("n_x") - 1) * (F.col("n_y") - 1))
    out = out.withColumn("statistic", F.when(F.col("df") > 0, stat))
    return out.withColumn("p_value", chi2_sf("statistic", "df")).select(
        *by, "n", "n_x", "n_y", "df", "min_expected", "statistic", "p_value")


def _level_cells(df: DataFrame, variables: Sequence[str], outcomes: Mapping[str, str],
                 by: Sequence[str], weight: str | None) -> DataFrame:
    """(by, outcome, variable, level, n1, n0) for every pair, from one collapsed pass."""
    patterns = patterns_of(df, [*by, *outcomes.values(), *variables], "__n", weight)
    levels = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables])
    flags = {o: F.col(f"__o_{o}") for o in outcomes}
    long = patterns.select(*by, "__n", *[F.col(c).cast("int").alias(f"__o_{o}") for o, c in outcomes.items()],
                           F.inline(levels))
    # null levels are left out inside the sums: a filter on the level would be pushed below the
    # collapse and stop other branches from sharing its exchange
    known, sums = F.col("level").isNotNull(), []
    for o, flag in flags.items():
        sums += [F.coalesce(F.sum(F.when(known & (flag == s), F.col("__n"))), F.lit(0)).alias(f"__{o}_{s}")
                 for s in (0, 1)]
    counted = long.groupBy(*by, "variable", "level").agg(*sums)
    cells = F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.col(f"__{o}_1").alias("n1"), F.col(f"__{o}_0").alias("n0"))
        for o in outcomes])
    return counted.select(*by, "variable", "level", F.inline(cells)).where(F.col("n1") + F.col("n0") > 0)


def association(df: DataFrame, variables: Sequence[str], outcomes: Mapping[str, str],
                by: Sequence[str] = (), weight: str | None = None,
                levels: Mapping[str, Levels] | None = None, p_values: bool = True) -> DataFrame:
    """Test of each 0/1 outcome against each categorical variable, over records knowing both.

    All expected counts above 5: Pearson; else all above 3: Pearson with correction; else
    the exact test. With ``levels`` a listed level
    without any record counts as an expected 0. Columns: outcome, variable, n, n_levels, df,
    min_expected, statistic, test and, with ``p_values``, p_value and p_error (see ``exact_p``; null unless exact).

    The choice is made on sums alone. Only tests that it leaves to the exact one are then carried out step by step, when
    this is called; without ``p_values`` nothing runs.
    """
    keys = [*by, "outcome", "variable"]
    cells = _level_cells(df, variables, outcomes, by, weight)
    if p_values:
        cells = cut_lineage(cells)
    chosen = _choice(cells, keys, levels)
    if not p_values:
        return chosen
    chosen = cut_lineage(chosen)
    exact = exact_p(_cells_of(cells, chosen.where(F.col("test") == FISHER), keys), keys)
    renamed = exact.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    out = chosen.withColumn("__pc", chi2_sf("statistic", "df")).join(renamed, same, "left")
    return out.select(*chosen.columns, F.when(F.col("test") == FISHER, F.col("p_value")).otherwise(F.col("__pc")).alias("p_value"), "p_error")


def _cells_of(cells: DataFrame, tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    wanted = tests.select(*[F.col(k).alias(f"__w_{k}") for k in keys])
    return cells.join(wanted, [F.col(k).eqNullSafe(F.col(f"__w_{k}")) for k in keys], "left_semi")


def _choice(cells: DataFrame, keys: Sequence[str], levels: Mapping[str, Levels] | None) -> DataFrame:
    """Sums of the cells of each test, the test they call for, and its statistic."""
    cells = beside(cells.withColumn("__r", F.col("n1") + F.col("n0")), keys, __c1=F.sum("n1"), __c0=F.sum("n0"))
    total = (F.col("__c1") + F.col("__c0")).cast("double")
    e1, e0 = F.col("__r") / total * F.col("__c1"), F.col("__r") / total * F.col("__c0")
    gap = F.abs(F.col("n1") - e1)
    out = cells.groupBy(*keys).agg(
        F.sum("__r").alias("n"), F.count(F.lit(1)).cast("int").alias("n_levels"),
        F.min(F.least(e1, e0)).alias("__min"), F.max("__c1").alias("__c1"), F.max("__c0").alias("__c0"),
        F.sum(nl.ratio(gap * gap, e1) + nl.ratio(gap * gap, e0)).alias("__plain"), F.max(gap).alias("__gap"),
        F.sum(nl.ratio(F.lit(1.0), e1) + nl.ratio(F.lit(1.0), e0)).alias("__inv"),
    )
    declared = F.lit(0)
    for v, lv in (levels or {}).items():
        declared = F.when(F.col("variable") == v, F.lit(len(lv.values))).otherwise(declared)
    shrunk = F.col("__gap") - F.least(F.lit(0.5), F.col("__gap"))
    out = out.withColumn("min_expected", F.when(F.col("n_levels") < declared, F.lit(0.0)).otherwise(F.col("__min")))
    out = out.withColumns({
        "df": F.col("n_levels") - 1,
        "test": F.when(F.col("min_expected") > 5, PEARSON).when(F.col("min_expected") > 3, CORRECTED)
                 .otherwise(FISHER)})
    square = (F.col("n_levels") == 2) & (F.col("test") == CORRECTED)
    testable = (F.col("__c1") > 0) & (F.col("__c0") > 0)
    stat = F.when(square, shrunk * shrunk * F.col("__inv")).otherwise(F.col("__plain"))
    return out.withColumn("statistic", F.when(testable & (F.col("test") != FISHER), stat)).select(
        *keys, "n", "n_levels", "df", "min_expected", "statistic", "test")


def fisher_exact(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """Exact r x 2 test of x against the 0/1 column y: n, n_levels, p_value and its bound of error (null if a margin is empty)."""
    cells = cut_lineage(_level_cells(df, [x], {"y": y}, (), weight))
    out = cells.groupBy("variable").agg(F.sum(F.col("n1") + F.col("n0")).alias("n"), F.count(F.lit(1)).cast("int").alias("n_levels"))
    return out.join(exact_p(cells.select("variable", "n1", "n0"), ["variable"]), "variable", "left")


def trend_test(counts: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Chi-square for linear trend in proportions, 1 df, over a tested/resistant table.

    Scores are 1..k in the order of ``score``; the statistic does not change when all scores
    shift, so centring them first keeps the sums small.
    """
    # the rank of a score needs its group's scores in order: one row per score, as in the report's years
    ranked = counts.withColumn("__s", F.row_number().over(Window.partitionBy(*by).orderBy(score)).cast("double"))
    ranked = beside(ranked, list(by), __n=F.sum("n_tested"), __x=F.sum("n_resistant"),
                    __m=nl.ratio(F.sum(F.col("__s") * F.col("n_tested")), F.sum("n_tested")))
    p = nl.ratio("__x", "__n")
    ranked = ranked.withColumn("__p", p).withColumn("__d", F.col("__s") - F.col("__m"))
    out = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).cast("int").alias("n_scores"), F.max("__n").alias("n_tested"),
        F.max("__x").alias("n_resistant"), F.max("__p").alias("__p"),
        F.sum(F.col("__d") * F.col("n_resistant")).alias("__a"),
        F.sum(F.col("__d") * F.col("__d") * F.col("n_tested")).alias("__b"))
    spread = F.col("__p") * (1 - F.col("__p")) * F.col("__b")
    out = out.withColumn("statistic", nl.ratio(F.col("__a") * F.col("__a"), spread))
    return out.withColumn("p_value", chi2_sf("statistic", F.lit(1))).select(
        *by, "n_scores", "n_tested", "n_resistant", "statistic", "p_value")
