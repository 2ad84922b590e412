"""Counting, description and prevalence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilar.functions.formats import format_n_pct, format_p, percent
from vigilar.functions.levels import Levels
from vigilar.operators import aggregate as agg
from vigilar.operators import derive, mic
from vigilar.operators import prevalence as prev
from vigilar.operators.describe import (
    VariableSpec, age_sex_table as build_age_sex, describe as build_description, describe_by as build_groups,
    describe_with_tests, population_flow as flow, profile_of_resistant as profile)
from vigilar.operators.windows import share
from vigilar.plans import fixed_values as fv
from vigilar.plans.surveillance import cohort_from_table, description_specs, yearly_figure, yearly_figure_long

from . import tests_sql
from . import views as v
from . import views_sql as s
from .registry import SQL, query

DRUGS = tuple(v.STATUS)
_TESTED = "(" + " UNION ALL ".join(
    f"SELECT '{d}' AS ATB, year_real, metrop, espece3, {c} AS status FROM iso WHERE {c} IS NOT NULL"
    for d, c in v.STATUS.items()) + ")"


def _counts(spark, sf, keys, where=None):
    table = v.isolates(spark, sf)
    return agg.tested_resistant_wide(table if where is None else table.where(where), keys,
                                     {c: d for d, c in v.STATUS.items()})


# ---------------------------------------------------------------- prevalence

_YEARLY = """SELECT ATB, year_real, espece3, n, tot, n_r, n / tot AS sp_perc_resist, n_r / tot AS yr_perc_resist, cum / tot AS cum_perc_resist FROM (
  SELECT ATB, year_real, espece3, sum(status) AS n, sum(count(*)) OVER (PARTITION BY ATB, year_real) AS tot,
  sum(sum(status)) OVER (PARTITION BY ATB, year_real) AS n_r,
  sum(sum(status)) OVER (PARTITION BY ATB, year_real ORDER BY espece3 NULLS LAST ROWS UNBOUNDED PRECEDING) AS cum
  FROM {src} WHERE metrop AND year_real BETWEEN 1995 AND 2001 AND ATB IN ({drugs}) GROUP BY ATB, year_real, espece3) WHERE n > 0"""


@query(f"WITH {s.ANALYSIS} " + _YEARLY.format(src=_TESTED, drugs="'CIP', 'C3G', 'AZM'"))
def yearly_resistance_by_species(spark, sf):
    """Flagship: yearly resistance by species, three drugs in one pass."""
    return yearly_figure(v.isolates(spark, sf), ["CIP", "C3G", "AZM"], v.YEARS)


@query(f"WITH {s.ANALYSIS} SELECT * EXCLUDE (ATB) FROM (" + _YEARLY.format(src=_TESTED, drugs="'AZM'") + ")")
def yearly_resistance_from_long(spark, sf):
    return yearly_figure_long(v.long_isolates(spark, sf), "AZM", v.YEARS)


@query(f"WITH {s.ANALYSIS} SELECT ATB, year_real, count(*) AS n_tested, sum(status) AS n_resistant, sum(status) / count(*) AS rate "
       f"FROM {_TESTED} WHERE metrop GROUP BY ALL")
def yearly_rate(spark, sf):
    return prev.yearly_rate(_counts(spark, sf, ["year_real"], F.col("metrop")))


@query(f"WITH {s.LONG} SELECT metrop, espece3, ATB, count(*) AS n_tested, sum(status) AS n_resistant FROM dl GROUP BY ALL")
def tested_resistant(spark, sf):
    return agg.tested_resistant(v.long_isolates(spark, sf), "metrop", "espece3", "ATB")


_GRID = """SELECT period, metrop, ATB, espece3, n_tested, n_resistant, CASE ATB WHEN 'C3G' THEN 1 WHEN 'CIP' THEN 2 WHEN 'AZM' THEN 3 WHEN 'NAL' THEN 4 END AS drug_rank,
  CASE ATB WHEN 'C3G' THEN '3GC' ELSE ATB END AS drug_name, {pct} AS value, 100.0 * n_resistant / n_tested < 50 AS value_bin,
  CASE WHEN 4 * n_resistant < n_tested THEN '0-25' WHEN 2 * n_resistant < n_tested THEN '25-50' WHEN 4 * n_resistant < 3 * n_tested THEN '50-75' ELSE '75-100' END AS value_cut
  FROM (SELECT CASE WHEN year_real <= 1996 THEN '1995-1996' WHEN year_real >= 2000 THEN '2000-2001' END AS period, metrop, ATB, espece3, count(*) AS n_tested,
  sum(status) AS n_resistant FROM {src} GROUP BY ALL) WHERE period IS NOT NULL AND espece3 IS NOT NULL AND ATB <> 'GEN'"""


@query(f"WITH {s.ANALYSIS} " + _GRID.format(src=_TESTED, pct=s.pct("n_resistant", "n_tested", 1)))
def resistance_grid(spark, sf):
    """Both periods and both regions as keys of one aggregate."""
    table = derive.period_bins(v.isolates(spark, sf), "year_real",
                               {"1995-1996": (1995, 1996), "2000-2001": (2000, 2001)}, "period")
    some = table.where(F.col("year_real").isin(1995, 1996, 2000, 2001))
    counts = agg.tested_resistant_wide(some, ["period", "metrop", "espece3"],
                                       {c: d for d, c in v.STATUS.items()})
    return prev.resistance_grid(counts, "espece3", "ATB", ["C3G", "CIP", "AZM", "NAL"], fv.DISPLAY_NAMES, fv.GRID_BINS)


@query(f"WITH {s.ANALYSIS} SELECT metrop, espece3, ATB, n_tested, n_resistant, {s.pct('n_resistant', 'n_tested', 2)} AS perc FROM "
       f"(SELECT metrop, espece3, ATB, count(*) AS n_tested, sum(status) AS n_resistant FROM {_TESTED} GROUP BY ALL)")
def prevalence_counts(spark, sf):
    """Counts and percentages under the prevalence matrix."""
    return _counts(spark, sf, ["metrop", "espece3"]).withColumn("perc", percent("n_resistant", "n_tested", 2))


_LIMITS_TEXT = f"CAST(n AS VARCHAR) || ', ' || {tests_sql.number('100.0 * (x / CAST(n AS DOUBLE))')} || ' (' || {tests_sql.number('100.0 * low')} || ';' || {tests_sql.number('100.0 * high')} || ')'"
_MATRIX = ("sonnei", "flexneri", "boydii", "dysenteriae")


@query(f"WITH RECURSIVE {s.ANALYSIS}, counts AS (SELECT metrop, espece3, ATB, count(*) AS n, CAST(sum(status) AS BIGINT) AS x FROM {_TESTED} GROUP BY ALL), "
       f"{tests_sql.exact_limits('counts')}, cells AS (SELECT metrop, espece3, ATB, {_LIMITS_TEXT} AS text FROM counts JOIN exact_limits USING (x, n)) "
       "SELECT metrop, ATB, " + ", ".join(f"max(text) FILTER (espece3 = '{sp}') AS {sp}" for sp in _MATRIX)
       + ", CASE ATB WHEN 'C3G' THEN 1 WHEN 'CIP' THEN 2 WHEN 'AZM' THEN 3 WHEN 'NAL' THEN 4 WHEN 'GEN' THEN 5 END AS drug_rank FROM cells GROUP BY metrop, ATB")
def prevalence_matrix(spark, sf):
    counts = _counts(spark, sf, ["metrop", "espece3"])
    return prev.prevalence_matrix(counts, ["metrop"], "espece3", _MATRIX, "ATB", ["C3G", "CIP", "AZM", "NAL", "GEN"])


@query(f"WITH RECURSIVE {s.ANALYSIS}, c AS (SELECT * FROM iso WHERE metrop AND espece3 IN ('sonnei', 'flexneri') AND CIP_SIR IS NOT NULL), "
       "lv AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS level, CIP_SIR AS st FROM c WHERE {c} IS NOT NULL" for c in fv.COHORTS["CIP"][1])
       + f"), counts AS (SELECT variable, level, count(*) AS n, CAST(sum(st) AS BIGINT) AS x FROM lv GROUP BY ALL), {tests_sql.exact_limits('counts')} "
         "SELECT variable, level, n AS n_tested, x AS n_resistant, round_even(100.0 * (x / CAST(n AS DOUBLE)), 2) AS perc, round_even(100.0 * low, 2) AS ci_low, "
         "round_even(100.0 * high, 2) AS ci_high FROM counts JOIN exact_limits USING (x, n)")
def prevalence_ci(spark, sf):
    cohort = cohort_from_table(v.isolates(spark, sf), "CIP")
    return prev.prevalence(cohort, fv.COHORTS["CIP"][1])


@query(f"WITH {s.ANALYSIS}, c AS (SELECT * FROM iso WHERE metrop AND espece3 IN ('sonnei', 'flexneri') AND CIP_SIR IS NOT NULL), "
       "x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS level, CIP_SIR AS st FROM c WHERE {c} IS NOT NULL"
                                     for c in fv.COHORTS["CIP"][1])
       + ") SELECT variable, level, count(*) AS n_tested, sum(st) AS n_resistant FROM x GROUP BY ALL")
def prevalence_levels(spark, sf):
    cohort = cohort_from_table(v.isolates(spark, sf), "CIP")
    return prev.level_counts(cohort, fv.COHORTS["CIP"][1], "status")


_SIX = ("CIP_SIR", "AZM_SIR", "C3G_SIR", "NAL_SIR", "GEN_SIR", "CAZ1030_SIR")
_NR = " + ".join(f"coalesce({c}, 0)" for c in _SIX)


@query(f"WITH {s.ANALYSIS}, g AS (SELECT metrop, espece3, count(*) FILTER ({_NR} = 0) AS n_susceptible, count(*) AS tot FROM iso GROUP BY ALL) "
       f"SELECT *, {s.pct('n_susceptible', 'tot', 2)} AS perc FROM g")
def fully_susceptible(spark, sf):
    return prev.fully_susceptible(v.isolates(spark, sf), _SIX, ["metrop", "espece3"])


@query(f"WITH {s.ANALYSIS} SELECT metrop, {_NR} AS n_R, count(*) AS n FROM iso GROUP BY ALL")
def resistance_count_distribution(spark, sf):
    return prev.resistance_count_distribution(v.isolates(spark, sf), _SIX, ["metrop"])


@query(f"WITH {s.ANALYSIS} SELECT row_id, {_NR} AS n_R FROM iso")
def row_total(spark, sf):
    return agg.row_total(v.isolates(spark, sf), _SIX).select("row_id", "n_R")


# ---------------------------------------------------------------- counting

@query(f"WITH {s.ANALYSIS} SELECT metrop, espece3, year_real, count(*) AS n FROM iso GROUP BY ALL")
def count_by(spark, sf):
    return agg.count_by(v.isolates(spark, sf, drugs=False), "metrop", "espece3", "year_real")


@query("SELECT 'min' AS stat, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice, min(l_discount) AS l_discount FROM lineitem "
       "UNION ALL SELECT 'max', max(l_quantity), max(l_extendedprice), max(l_discount) FROM lineitem")
def column_range(spark, sf):
    return agg.column_range(v.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(f"WITH {s.ANALYSIS} SELECT metrop, quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.5) AS median, quantile_cont(age, 0.75) AS q3 "
       "FROM iso GROUP BY metrop")
def quartiles(spark, sf):
    return agg.quartiles(v.isolates(spark, sf, drugs=False), "age", ["metrop"])


@query()
def approximate_quartiles(spark, sf):
    """Sketched quartiles of a continuous measure."""
    return agg.approximate_quartiles(v.table(spark, sf, "events"), "value", ["event_type"])


_WIDE = tuple(f"{d}_d" for d in v.DRUGS.values())


@query(f"WITH {s.RAW}, x AS (" + " UNION ALL ".join(f"SELECT year, '{c}' AS variable, {c} AS x FROM raw" for c in _WIDE)
       + f"), g AS (SELECT year, variable, count(*) AS n, count(*) FILTER (x IS NULL) AS n_missing FROM x GROUP BY ALL) "
         f"SELECT *, {s.pct('n_missing', 'n', 1)} AS pct_missing FROM g")
def missing_by_column(spark, sf):
    return agg.missing_by_column(v.raw_isolates(spark, sf), _WIDE, ["year"])


@query(f"WITH {s.RAW} SELECT {' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in _WIDE)} AS n_missing, count(*) AS n FROM raw GROUP BY 1")
def missing_per_row(spark, sf):
    return agg.missing_per_row(v.raw_isolates(spark, sf), _WIDE)


@query(f"WITH {s.RAW} SELECT CAST(AZM_d IS NOT NULL AS INTEGER) + CAST(CTX_d IS NOT NULL AS INTEGER) + CAST(CTX_SIR IS NOT NULL AS INTEGER) AS n_filled, "
       "count(*) AS n FROM raw GROUP BY 1")
def co_measured(spark, sf):
    return agg.co_measured(v.raw_isolates(spark, sf), ["AZM_d", "CTX_d", "CTX_SIR"])


@query(f"WITH {s.ANALYSIS} SELECT count(*) FILTER (age_cut IS NULL AND sexe IS NOT NULL) AS only_first, count(*) FILTER (age_cut IS NOT NULL AND sexe IS NULL) "
       "AS only_second, count(*) FILTER (age_cut IS NULL AND sexe IS NULL) AS both FROM iso")
def missing_patterns(spark, sf):
    return agg.missing_patterns(v.isolates(spark, sf, drugs=False), "age_cut", "sexe")


@query(f"WITH {s.ANALYSIS} SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT person) AS n_person, count(DISTINCT num_CNR) AS n_num_CNR, "
       "count(DISTINCT voyage) AS n_voyage FROM iso")
def distinct_counts(spark, sf):
    return agg.distinct_count(v.isolates(spark, sf, drugs=False), ["person", "num_CNR", "voyage"])


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_values(spark, sf):
    return agg.distinct_values(v.table(spark, sf, "documents"), "lang", "source")


@query(f"WITH {s.ANALYSIS}, g AS (SELECT x, y FROM (SELECT unnest(['< 15', '15-49', '50 +']) AS x), (SELECT unnest(['F', 'M', 'X']) AS y)) "
       "SELECT g.x AS age_cut, g.y AS sexe, coalesce(n, 0) AS n FROM g LEFT JOIN (SELECT age_cut, sexe, count(*) AS n FROM iso GROUP BY ALL) c "
       "ON g.x = c.age_cut AND g.y = c.sexe")
def contingency(spark, sf):
    return agg.contingency(v.isolates(spark, sf, drugs=False), "age_cut", "sexe", x_levels=fv.AGE_LEVELS,
                           y_levels=["F", "M", "X"])


def _freq_sql(variable, levels, with_null):
    lines = [f"('{lv}')" for lv in levels] + (["(CAST(NULL AS VARCHAR))"] if with_null else [])
    return (f"t AS (SELECT g.level, coalesce(n, 0) AS freq FROM (VALUES {', '.join(lines)}) g(level) LEFT JOIN "
            f"(SELECT CAST({variable} AS VARCHAR) AS level, count(*) AS n FROM iso GROUP BY 1) c ON g.level IS NOT DISTINCT FROM c.level) "
            f"SELECT '{variable}' AS variable, level, freq, CASE WHEN level IS NOT NULL THEN "
            f"{s.pct('freq', '(SELECT sum(freq) FROM t WHERE level IS NOT NULL)', 1)} END AS percent FROM t")


@query(f"WITH {s.ANALYSIS}, " + _freq_sql("continent", fv.CONTINENTS, True))
def freq_table(spark, sf):
    return agg.freq_table(v.isolates(spark, sf, drugs=False), "continent", "always", Levels.of(fv.CONTINENTS))


@query(f"WITH {s.ANALYSIS}, " + _freq_sql("metrop", ("false", "true"), True), name="freq_table_no_missing")
def _freq_table_no_missing(spark, sf):
    """The null line appears with 0."""
    return agg.freq_table(v.isolates(spark, sf, drugs=False), "metrop", "always")


@query(f"WITH {s.ANALYSIS} SELECT CASE WHEN labo = 'institut' THEN 'hospitalise' ELSE labo END AS labo, count(*) AS n, "
       "count(*) / sum(count(*)) OVER () AS share FROM iso GROUP BY 1")
def proportions(spark, sf):
    table = v.isolates(spark, sf, drugs=False).withColumn(
        "labo", F.when(F.col("labo") == "institut", "hospitalise").otherwise(F.col("labo")))
    return agg.proportions(table, "labo")


# ---------------------------------------------------------------- description

SPECS = description_specs(tuple(v.PERIODS))
_LEVELS = {sp.name: sp.levels.values for sp in SPECS if sp.levels}
_POLICY = {sp.name: sp.na_policy for sp in SPECS}
_TEMPLATE = ", ".join(
    f"('{n}', {('NULL' if lv is None else chr(39) + lv + chr(39))})"
    for n in _POLICY for lv in [*_LEVELS.get(n, ()), *([None] if _POLICY[n] == "always" else [])])


def _described(cells: str, where: str, final: str) -> str:
    """Counts per (variable, level) over the template and the levels found."""
    long = " UNION ALL ".join(f"SELECT '{n}' AS variable, CAST({n} AS VARCHAR) AS level, * FROM iso" for n in _POLICY)
    names = [c.split(" AS ")[-1] for c in cells.split(";")]
    return (
        f"lng AS ({long}), cnt AS (SELECT variable, level, {cells.replace(';', ',')} FROM lng WHERE {where} GROUP BY variable, level), "
        f"tpl AS (SELECT * FROM (VALUES {_TEMPLATE}) t(variable, level) UNION SELECT variable, level FROM cnt WHERE level IS NOT NULL), "
        "full_t AS (SELECT t.variable, t.level, " + ", ".join(f"coalesce(c.{n}, 0) AS {n}" for n in names)
        + " FROM tpl t LEFT JOIN cnt c ON t.variable = c.variable AND t.level IS NOT DISTINCT FROM c.level), "
        "known AS (SELECT variable, " + ", ".join(f"sum({n}) FILTER (level IS NOT NULL) AS k_{n}" for n in names)
        + f" FROM full_t GROUP BY variable) {final}")


@query(f"WITH {s.ANALYSIS}, " + _described(
    "count(*) AS n", "TRUE",
    f"SELECT variable, coalesce(level, 'missing') AS level, n, CASE WHEN level IS NOT NULL THEN {s.pct('n', 'k_n', 1)} END AS percent, "
    f"CASE WHEN level IS NULL THEN CAST(n AS VARCHAR) ELSE {s.n_pct('n', 'k_n')} END AS freq FROM full_t JOIN known USING (variable)"))
def describe(spark, sf):
    return build_description(v.isolates(spark, sf, drugs=False), SPECS)


GROUPS = {f"{d}_{letter}": (f"{d}_SIR", bit) for d in fv.DESCRIBED_DRUGS for letter, bit in (("R", 1), ("S", 0))}
_GROUP_CELLS = ";".join(f"count(*) FILTER ({c} = {b}) AS {g}" for g, (c, b) in GROUPS.items())


@query(f"WITH {s.ANALYSIS}, " + _described(
    _GROUP_CELLS, "metrop",
    "SELECT variable, coalesce(level, 'missing') AS level, " + ", ".join(
        f"CASE WHEN level IS NULL THEN CAST({g} AS VARCHAR) ELSE {s.n_pct(g, f'k_{g}')} END AS {g}" for g in GROUPS)
    + " FROM full_t JOIN known USING (variable)"))
def describe_by(spark, sf):
    return build_groups(v.isolates(spark, sf).where("metrop"), SPECS, GROUPS)


_RANKS = ", ".join(f"('{n}', '{lv}', {i})" for n, lvs in _LEVELS.items() for i, lv in enumerate(lvs, 1))
_HEADINGS = ", ".join(f"('{sp.name}', '{(sp.heading or sp.name).replace(chr(39), chr(39) * 2)}')" for sp in SPECS)


def _tested_sql(table: str, outcomes: dict[str, str], where: str, groups) -> str:
    """A description, numbered in blocks, with the p of each outcome on the first line of a block."""
    long = " UNION ALL ".join(f"SELECT '{o}' AS outcome, '{n}' AS variable, CAST({n} AS VARCHAR) AS level, {y} AS y FROM iso WHERE {where}"
                              for o, y in outcomes.items() for n in _POLICY)
    declared = {n: len(lvs) for n, lvs in _LEVELS.items()}
    return f"""WITH {tests_sql.association_p(s.ANALYSIS, long, 'outcome, variable', 12, declared)}, base AS ({table}),
  numbered AS (SELECT b.*, row_number() OVER (PARTITION BY b.variable ORDER BY b.level = 'missing', r.place NULLS LAST, b.level) AS nr
    FROM base b LEFT JOIN (VALUES {_RANKS}) r(variable, level, place) ON r.variable = b.variable AND r.level = b.level)
  SELECT n.variable, nr, CASE WHEN nr = 1 THEN heading END AS heading, n.level, {', '.join(f'n.{g}' for g in groups)}, """ + ", ".join(
        f"CASE WHEN nr = 1 THEN (SELECT round(p_value, 3) FROM tested t WHERE t.variable = n.variable AND t.outcome = '{o}') END AS p_{o}" for o in outcomes) + f"""
  FROM numbered n JOIN (VALUES {_HEADINGS}) h(variable, heading) ON h.variable = n.variable"""


@query(_tested_sql(SQL["describe_by"], {d: f"{d}_SIR" for d in fv.DESCRIBED_DRUGS}, "metrop", GROUPS))
def describe_by_with_tests(spark, sf):
    """Resistant and susceptible side by side with test p-values, one pass over the records."""
    return describe_with_tests(v.isolates(spark, sf).where("metrop"), SPECS, GROUPS,
                               {d: f"{d}_SIR" for d in fv.DESCRIBED_DRUGS})


REGIONS = {"main": ("metrop", True), "other": ("metrop", False)}


@query(f"WITH {s.ANALYSIS}, " + _described(
    ";".join(f"count(*) FILTER ({'' if value else 'NOT '}metrop) AS {g}" for g, (_, value) in REGIONS.items()), "TRUE",
    "SELECT variable, coalesce(level, 'missing') AS level, " + ", ".join(
        f"CASE WHEN level IS NULL THEN CAST({g} AS VARCHAR) ELSE {s.n_pct(g, f'k_{g}')} END AS {g}" for g in REGIONS)
    + " FROM full_t JOIN known USING (variable)"))
def describe_by_region(spark, sf):
    """The whole population, main region beside the others."""
    return build_groups(v.isolates(spark, sf, drugs=False), SPECS, REGIONS)


@query(_tested_sql(SQL["describe_by_region"], {"region": "CAST(metrop AS INTEGER)"}, "TRUE", REGIONS))
def describe_by_region_with_tests(spark, sf):
    """The same with the test of each variable against the region."""
    rows = v.isolates(spark, sf, drugs=False).withColumn("in_main", F.col("metrop").cast("int"))
    return describe_with_tests(rows, SPECS, REGIONS, {"region": "in_main"})


_C = fv.COHORTS["CIP"][1]
_FULL = " AND ".join(f"{c} IS NOT NULL" for c in _C)
_FLOW = {
    "n_all": "count(*)", "n_complete": f"count(*) FILTER ({_FULL})", "n_dropped": f"count(*) FILTER (NOT ({_FULL}))",
    "missing_status": "count(*) FILTER (CIP_SIR IS NULL)", **{f"missing_{c}": f"count(*) FILTER ({c} IS NULL)" for c in _C},
    "only_age_cut": "count(*) FILTER (age_cut IS NULL AND sexe IS NOT NULL)",
    "only_sexe": "count(*) FILTER (age_cut IS NOT NULL AND sexe IS NULL)",
    "both": "count(*) FILTER (age_cut IS NULL AND sexe IS NULL)", "events_all": "count(*) FILTER (CIP_SIR = 1)",
    "events_complete": f"count(*) FILTER (CIP_SIR = 1 AND {_FULL})"}


@query(f"WITH {s.ANALYSIS}, c AS (SELECT * FROM iso WHERE metrop AND espece3 IN ('sonnei', 'flexneri') AND CIP_SIR IS NOT NULL) "
       + " UNION ALL ".join(f"SELECT '{k}' AS measure, {e} AS n FROM c" for k, e in _FLOW.items()))
def population_flow(spark, sf):
    return flow(cohort_from_table(v.isolates(spark, sf), "CIP"), _C, "status", ("age_cut", "sexe"))


_AS = ", ".join(
    f"coalesce(max(text) FILTER (k = '{c}'), '0(0)') AS \"{c}\"" for c in (*fv.AGE_SEX_LEVELS, "unknown"))


@query(f"WITH {s.ANALYSIS}, x AS (" + " UNION ALL ".join(
    f"SELECT espece3 AS species, '{d}_' || CASE {d}_SIR WHEN 0 THEN 'S' WHEN 1 THEN 'R' ELSE 'NA' END AS ATB, coalesce(age_sexe, 'unknown') AS k FROM iso "
    "WHERE metrop AND espece3 IN ('sonnei', 'flexneri')" for d in fv.DESCRIBED_DRUGS)
    + "), g AS (SELECT species, ATB, k, count(*) AS n, sum(count(*)) OVER (PARTITION BY species, ATB) AS tot FROM x GROUP BY species, ATB, k), "
      f"t AS (SELECT species, ATB, k, {s.n_pct('n', 'tot')} AS text FROM g) SELECT species, ATB, {_AS} FROM t GROUP BY species, ATB")
def age_sex_table(spark, sf):
    return build_age_sex(v.isolates(spark, sf).where("metrop"), "espece3", ["sonnei", "flexneri"], "age_sexe",
                         fv.AGE_SEX_LEVELS, {d: f"{d}_SIR" for d in fv.DESCRIBED_DRUGS}, with_p=False)


_AGE_SEX_LONG = " UNION ALL ".join(
    f"SELECT espece3 AS species, '{d}' AS outcome, 'age_sexe' AS variable, age_sexe AS level, {d}_SIR AS y FROM iso WHERE metrop AND espece3 IN ('sonnei', 'flexneri')"
    for d in fv.DESCRIBED_DRUGS)


@query("WITH " + tests_sql.association_p(s.ANALYSIS, _AGE_SEX_LONG, "species, outcome, variable", 12, {"age_sexe": len(fv.AGE_SEX_LEVELS)})
       + f", base AS ({SQL['age_sex_table']}) SELECT b.*, round(p_value, 4) AS p_value, {tests_sql.p_text('p_value', 0.001)} AS p_text, test "
         "FROM base b LEFT JOIN tested t ON t.species = b.species AND t.outcome || '_S' = b.ATB")
def age_sex_table_with_tests(spark, sf):
    out = build_age_sex(v.isolates(spark, sf).where("metrop"), "espece3", ["sonnei", "flexneri"], "age_sexe",
                        fv.AGE_SEX_LEVELS, {d: f"{d}_SIR" for d in fv.DESCRIBED_DRUGS})
    return out.withColumn("p_value", F.round("p_value", 4))


_ATTR = ("espece3", "espece", "voyage", "continent", "labo")


@query(f"WITH {s.ANALYSIS}, r AS (SELECT * FROM iso WHERE metrop AND CIP_SIR = 1), x AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS variable, {a} AS level FROM r" for a in _ATTR)
    + ") SELECT variable, level, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY variable) AS share FROM x GROUP BY variable, level")
def profile_of_resistant(spark, sf):
    return profile(v.isolates(spark, sf), F.col("metrop") & (F.col("CIP_SIR") == 1), _ATTR)


@query(f"WITH {s.ANALYSIS}, r AS (SELECT * FROM iso WHERE metrop AND CIP_SIR = 1 AND year_real = 1997 AND contains(espece, 'flexneri')), x AS ("
       + " UNION ALL ".join(f"SELECT '{a}' AS variable, {a} AS level FROM r" for a in _ATTR)
       + ") SELECT variable, level, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY variable) AS share FROM x GROUP BY variable, level")
def profile_of_resistant_year(spark, sf):
    """The profile of one year's resistant records whose species text names one species."""
    rows = v.isolates(spark, sf)
    return profile(rows, F.col("metrop") & (F.col("CIP_SIR") == 1) & (F.col("year_real") == 1997) & F.contains("espece", F.lit("flexneri")), _ATTR)


# ---------------------------------------------------------------- formatting

@query("""WITH g AS (SELECT l_shipdate, n, r, CAST(r AS DOUBLE) / n / 300 AS p FROM (SELECT CAST(l_shipdate AS DATE) AS l_shipdate, count(*) AS n,
  count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1))
  SELECT l_shipdate, """ + s.n_pct("r", "n") + """ AS text, CASE WHEN round_even(p, 3) = 0 THEN '<0.001' ELSE regexp_replace(printf('%.3f', round_even(p, 3)), '\\.?0+$', '') END AS p_text,
  CASE WHEN p <= 0.001 THEN '<0.001' ELSE regexp_replace(printf('%.3f', round_even(p, 3)), '\\.?0+$', '') END AS p_text_bound FROM g""")
def format_report(spark, sf):
    """``n (pct)`` and p-value texts for every shipping day."""
    days = v.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("l_shipdate")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    p = F.col("r").cast("double") / F.col("n") / 300
    return days.select("l_shipdate", format_n_pct("r", "n").alias("text"), format_p(p).alias("p_text"),
                       format_p(p, 0.001).alias("p_text_bound"))


# ---------------------------------------------------------------- MIC

_MIC = "CASE WHEN contains(t, '256') THEN 256.0 ELSE TRY_CAST(replace(t, ',', '.') AS DOUBLE) END"
_EV = ("ev AS (SELECT event_id, user_id, event_type, CASE WHEN value > 200 THEN '>256' ELSE replace(CAST(CAST(floor(value / 8) AS BIGINT) AS VARCHAR) || '.5', '.', ',') END AS t FROM events)")


def _mic_events(spark, sf):
    value = F.col("value")
    text = F.when(value > 200, ">256").otherwise(
        F.concat(F.floor(value / 8).cast("string"), F.lit(",5")))
    return v.table(spark, sf, "events").select("event_id", "user_id", "event_type", text.alias("t"))


@query(f"WITH {_EV} SELECT event_id, {_MIC} AS mic, least({_MIC}, 32.0) AS capped, "
       f"CASE WHEN {_MIC} = 256 THEN '>256' ELSE CAST({_MIC} AS VARCHAR) END AS label FROM ev")
def censor_mic(spark, sf):
    out = derive.censor_mic(_mic_events(spark, sf), "t", "mic")
    out = derive.censor_mic(out, "t", "capped", cap=fv.MIC_CAP)
    return out.select("event_id", "mic", "capped", derive.mic_label("mic").alias("label"))


@query(f"WITH {_EV}, u AS (SELECT user_id, max({_MIC}) FILTER (event_type = 'click') AS a, max({_MIC}) FILTER (event_type = 'view') AS b FROM ev GROUP BY 1) "
       "SELECT a, b, count(*) AS n_same_combination FROM u GROUP BY ALL")
def mic_joint(spark, sf):
    rows = derive.censor_mic(_mic_events(spark, sf), "t", "mic")
    pair = rows.groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "click", F.col("mic"))).alias("a"),
        F.max(F.when(F.col("event_type") == "view", F.col("mic"))).alias("b"))
    return mic.mic_joint(pair, "a", "b")


_MIC_LEVELS = ("0.5", "1.5", "2.5", "4.5", "8.5", "16.5", "32", ">256")


@query(f"WITH {_EV}, l AS (SELECT CASE WHEN m = 256 THEN '>256' WHEN m >= 30 THEN '32' ELSE CAST(m AS VARCHAR) END AS level FROM (SELECT {_MIC} AS m FROM ev)) "
       "SELECT g.level_rank, g.level, coalesce(n, 0) AS n_isolates, (SELECT count(*) FROM l) AS n_tested FROM (VALUES "
       + ", ".join(f"({i + 1}, '{lv}')" for i, lv in enumerate(_MIC_LEVELS))
       + ") g(level_rank, level) LEFT JOIN (SELECT level, count(*) AS n FROM l GROUP BY 1) c ON g.level = c.level")
def mic_distribution(spark, sf):
    rows = derive.censor_mic(_mic_events(spark, sf), "t", "mic")
    value = F.col("mic")
    folded = F.when(value == 256, value).when(value >= 30, F.lit(32.0)).otherwise(value)
    return mic.mic_distribution(rows.select(derive.mic_label(folded).alias("level")), "level", _MIC_LEVELS)


@query(f"WITH {s.ANALYSIS} SELECT CAST(coalesce(sum(C3G_SIR), 0) AS BIGINT) AS n_resistant FROM iso")
def resistant_total(spark, sf):
    return mic.resistant_total(v.isolates(spark, sf), "C3G_SIR")
