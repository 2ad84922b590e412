"""Descriptive tables. Each is one counting pass over the records; formatting and shares
work on the counted combinations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nulls as nl
from ..functions.formats import format_n_pct, format_p, percent
from ..functions.levels import Levels
from ..plans.session import compiled
from ..sources.tables import cut_lineage
from .aggregate import beside, collapse, long_counts, patterns_of
from .association import association
from .columns import apart
from .reshape import to_wide

MISSING = "missing"


@dataclass(frozen=True)
class VariableSpec:
    """A described variable: null-line policy, optional levels, report heading."""

    name: str
    na_policy: str = "always"
    levels: Levels | None = None
    heading: str | None = None


def _scaffold(spark, specs: Sequence[VariableSpec]) -> DataFrame | None:
    """(variable, level) lines that must appear even without any record."""
    lines = []
    for s in specs:
        values = [F.lit(v) for v in (s.levels.ordered if s.levels else ())]
        if s.na_policy == "always":
            values.append(F.lit(None).cast("string"))
        lines += [F.struct(F.lit(s.name).alias("variable"), v.alias("level")) for v in values]
    return spark.range(1).select(F.inline(F.array(*lines))) if lines else None


def _lines(counts: DataFrame, specs: Sequence[VariableSpec], cells: Sequence[str]) -> DataFrame:
    """Add scaffold lines with 0 and drop the lines the null policy hides."""
    scaffold = _scaffold(counts.sparkSession, specs)
    if scaffold is not None:
        zero = scaffold.select("variable", "level", *[F.lit(0).cast("long").alias(c) for c in cells])
        counts = counts.unionByName(zero).groupBy("variable", "level").agg(
            *[F.sum(c).alias(c) for c in cells])
    hidden = [s.name for s in specs if s.na_policy == "no"]
    counts = counts.where(~(F.col("level").isNull() & F.col("variable").isin(hidden))) if hidden else counts
    for s in specs:
        if s.levels:
            listed = F.col("level").isNull() | F.col("level").isin(list(s.levels.values))
            counts = counts.where((F.col("variable") != s.name) | listed)
    return counts


def _text(cell: str) -> Column:
    return F.when(F.col("level").isNull(), F.col(cell).cast("string")).otherwise(
        format_n_pct(cell, f"__k_{cell}", 1))


def _with_known(lines: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Totals over the known levels of each variable, one aggregate for all cells."""
    return beside(lines, ["variable"], **{
        f"__k_{c}": F.sum(F.when(F.col("level").isNotNull(), F.col(c))) for c in cells})


def describe(df: DataFrame, specs: Sequence[VariableSpec], name: str = "freq",
             weight: str | None = None) -> DataFrame:
    """Stacked frequency tables: (variable, level, n, percent, text).

    Percentages are over known values; the null line reads "missing" and has none.
    """
    counts = long_counts(df, [s.name for s in specs], weight=weight)
    lines = _with_known(_lines(counts, specs, ["n"]), ["n"])
    return lines.select(
        "variable", F.coalesce("level", F.lit(MISSING)).alias("level"), "n",
        F.when(F.col("level").isNotNull(), percent("n", "__k_n", 1)).alias("percent"),
        _text("n").alias(name),
    )


def describe_by(df: DataFrame, specs: Sequence[VariableSpec], groups: Mapping[str, tuple[str, object]],
                weight: str | None = None) -> DataFrame:
    """The same side by side for subgroups (``groups``: column name -> (column, value)).

    Subgroups are conditional sums over the counted combinations, so overlapping subgroups
    cost no further pass.
    """
    variables = [s.name for s in specs]
    flags = sorted({c for c, _ in groups.values()})
    patterns = patterns_of(df, [*flags, *variables], "__n", weight)
    packed = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables])
    cells = {
        g: F.coalesce(F.sum(F.when(F.col(f"__g_{c}") == F.lit(v), F.col("__n"))), F.lit(0)).alias(g)
        for g, (c, v) in groups.items()
    }
    counts = (
        patterns.select("__n", *[F.col(c).alias(f"__g_{c}") for c in flags], F.inline(packed))
        .groupBy("variable", "level").agg(*cells.values())
    )
    lines = _with_known(_lines(counts, specs, list(groups)), list(groups))
    return lines.select("variable", F.coalesce("level", F.lit(MISSING)).alias("level"),
                        *[_text(g).alias(g) for g in groups])


def describe_with_tests(df: DataFrame, specs: Sequence[VariableSpec],
                        groups: Mapping[str, tuple[str, object]],
                        outcomes: Mapping[str, str]) -> DataFrame:
    """Subgroup description with the association p-value of each outcome (``outcomes``: name ->
    0/1 column) and the heading on the first line of a variable's block.

    Records are collapsed once, when this is called; the checkpointed counts feed both the table and the tests.
    """
    variables = [s.name for s in specs]
    columns = list(dict.fromkeys([*outcomes.values(), *[c for c, _ in groups.values()], *variables]))
    with compiled(df.sparkSession):
        patterns = cut_lineage(collapse(apart(df, columns), columns, "__w"))
    table = describe_by(patterns, specs, groups, weight="__w")
    tests = association(patterns, variables, outcomes, weight="__w",
                        levels={s.name: s.levels for s in specs if s.levels})
    tests = to_wide(tests, ["variable"], "outcome", list(outcomes), "p_value", prefix="p_").withColumnRenamed(
        "variable", "__variable")
    rank = F.lit(None).cast("int")
    for s in specs:
        if s.levels:
            rank = F.when(F.col("variable") == s.name, s.levels.rank("level")).otherwise(rank)
    block = Window.partitionBy("variable").orderBy(
        (F.col("level") == MISSING).asc(), F.col("__rank").asc_nulls_last(), F.col("level"))
    joined = table.withColumn("__rank", rank).withColumn("nr", F.row_number().over(block)).join(
        tests, F.col("variable") == F.col("__variable"), "left")
    headings = F.coalesce(*[F.when(F.col("variable") == s.name, F.lit(s.heading or s.name)) for s in specs])
    first = F.col("nr") == 1
    return joined.select(
        "variable", "nr", F.when(first, headings).alias("heading"), "level", *groups,
        *[F.when(first, F.round(f"p_{o}", 3)).alias(f"p_{o}") for o in outcomes])


def population_flow(df: DataFrame, variables: Sequence[str], status: str, pair: tuple[str, str]) -> DataFrame:
    """Records, complete records, dropped records, nulls per variable, joint null patterns of
    two variables and events: one row per measure, from one aggregate."""
    needed = [status, *variables]
    complete = nl.null_count(needed) == 0
    a, b = F.col(pair[0]).isNull(), F.col(pair[1]).isNull()
    event = F.col(status) == 1
    measures = {
        "n_all": F.count(F.lit(1)),
        "n_complete": F.count_if(complete),
        "n_dropped": F.count_if(~complete),
        **{f"missing_{c}": F.count_if(F.col(c).isNull()) for c in needed},
        f"only_{pair[0]}": F.count_if(a & ~b),
        f"only_{pair[1]}": F.count_if(~a & b),
        "both": F.count_if(a & b),
        "events_all": F.count_if(event),
        "events_complete": F.count_if(event & complete),
    }
    agg = df.agg(*[m.alias(k) for k, m in measures.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("n")) for k in measures])
    return agg.select(F.inline(rows))


def age_sex_table(df: DataFrame, species: str, species_kept: Sequence[str], age_sex: str,
                  age_sex_levels: Sequence[str], drugs: Mapping[str, str],
                  with_p: bool = True) -> DataFrame:
    """Per species and drug status: ``n (pct)`` by age-and-sex class, percentage within the
    status, empty cells ``0(0)``; the p-value stands on the S line."""
    # the explicit null test is what the join with the tests infers; both sides then share one scan
    some = df.where(F.col(species).isNotNull() & F.col(species).isin(list(species_kept)))
    patterns = collapse(some, [species, age_sex, *drugs.values()], "__w")
    if with_p:
        patterns = cut_lineage(patterns)  # for the table and the tests
    packed = F.array(*[
        F.struct(F.lit(d).alias("drug"), F.col(c).alias("status")) for d, c in drugs.items()])
    counts = (
        patterns.select(species, age_sex, "__w", F.inline(packed))
        .groupBy(species, "drug", "status", age_sex).agg(F.sum("__w").alias("n"))
    )
    counts = counts.withColumn("__total", F.sum("n").over(Window.partitionBy(species, "drug", "status")))
    letter = F.when(F.col("status") == 0, "S").when(F.col("status") == 1, "R").otherwise("NA")
    cells = counts.select(
        F.col(species).alias("species"), F.concat("drug", F.lit("_"), letter).alias("ATB"),
        F.coalesce(age_sex, F.lit("unknown")).alias("__class"), format_n_pct("n", "__total", 1).alias("text"))
    table = to_wide(cells, ["species", "ATB"], "__class", [*age_sex_levels, "unknown"], "text", missing="0(0)")
    if not with_p:
        return table
    tests = association(patterns, [age_sex], drugs, by=[species], weight="__w",
                        levels={age_sex: Levels.of(age_sex_levels)})
    tests = tests.select(F.col(species).alias("__s"), F.concat("outcome", F.lit("_S")).alias("__a"),
                         "p_value", format_p("p_value", 0.001).alias("p_text"), "test")
    return table.join(
        tests, (F.col("species") == F.col("__s")) & (F.col("ATB") == F.col("__a")), "left").drop("__s", "__a")


def profile_of_resistant(df: DataFrame, condition: Column, attributes: Sequence[str]) -> DataFrame:
    """Records meeting the condition, by each attribute: count and share, null level included."""
    counts = long_counts(df.where(condition), attributes)
    counts = beside(counts, ["variable"], __total=F.sum("n"))
    return counts.withColumn("share", nl.ratio("n", "__total")).drop("__total")
