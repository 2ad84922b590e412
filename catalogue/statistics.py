"""Association, trend and regression queries.

Statistics are rounded to six decimals on both sides; p-values and iterated fits have no SQL
counterpart and are checked in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilar.functions.levels import Levels
from vigilar.operators import association as asc
from vigilar.operators import logit, reshape
from vigilar.operators.prevalence import yearly_line
from vigilar.plans import fixed_values as fv
from vigilar.plans.surveillance import cohort_from_table

from . import tests_sql
from . import views as v
from . import views_sql as s
from .registry import SQL, query
from .tables import _counts, _TESTED


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---------------------------------------------------------------- contingency tests

_GRID = """g AS (SELECT a.x, b.y, coalesce(c.n, 0) AS o, a.r * b.c / CAST(t.n AS DOUBLE) AS e FROM
  (SELECT x, sum(n) AS r FROM k GROUP BY x) a, (SELECT y, sum(n) AS c FROM k GROUP BY y) b, (SELECT sum(n) AS n FROM k) t
  LEFT JOIN k c ON c.x = a.x AND c.y = b.y)"""


@query(f"WITH {s.OUT}, k AS (SELECT lang AS x, source AS y, count(*) AS n FROM outc GROUP BY ALL), {_GRID} "
       "SELECT sum(o) AS n, CAST(count(DISTINCT x) AS INTEGER) AS n_x, CAST(count(DISTINCT y) AS INTEGER) AS n_y, "
       "CAST((count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS INTEGER) AS df, round(min(e), 6) AS min_expected, "
       "round(sum((o - e) * (o - e) / e), 6) AS statistic FROM g")
def chi_square(spark, sf):
    """Language by source, with empty cells."""
    return _rounded(asc.chi_square(v.labelled_documents(spark, sf), "lang", "source"), "min_expected", "statistic").drop("p_value")


@query(f"WITH {s.OUT}, k AS (SELECT quality AS x, toxic AS y, count(*) AS n FROM outc GROUP BY ALL), {_GRID} "
       "SELECT sum(o) AS n, 2 AS n_x, 2 AS n_y, 1 AS df, round(min(e), 6) AS min_expected, "
       "round(sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e), 6) AS statistic FROM g")
def chi_square_corrected(spark, sf):
    return _rounded(asc.chi_square(v.labelled_documents(spark, sf), "quality", "toxic", yates=True),
                    "min_expected", "statistic").drop("p_value")


_ASSOCIATION = "n, n_levels, df, round(min_expected, 6) AS min_expected, test, round(statistic, 6) AS statistic"


def _association_sql(ctes: str, long: str, keys: str) -> str:
    return f"WITH {tests_sql.association(ctes, long, keys)} SELECT {keys}, {_ASSOCIATION} FROM chosen"


_DOC_VARIABLES = ("lang", "source", "size", "quality")
_DOCS_LONG = " UNION ALL ".join(
    f"SELECT '{o}' AS outcome, '{x}' AS variable, CAST({x} AS VARCHAR) AS level, {o} AS y FROM outc"
    for o in ("quality", "toxic") for x in _DOC_VARIABLES if x != o)


def _documents_association(spark, sf, p_values):
    docs = v.labelled_documents(spark, sf)
    return asc.association(docs, _DOC_VARIABLES, {"quality": "quality", "toxic": "toxic"}, p_values=p_values).where(
        F.col("variable") != F.col("outcome"))


@query(_association_sql(s.OUT, _DOCS_LONG, "outcome, variable"))
def association(spark, sf):
    """Test choice and statistic of two outcomes against all covariates, from one pass."""
    return _rounded(_documents_association(spark, sf, False), "min_expected", "statistic")


@query(f"WITH {tests_sql.association_p(s.OUT, _DOCS_LONG, 'outcome, variable', 20)} SELECT outcome, variable, test, round(p_value, 4) AS p_value FROM tested")
def association_p(spark, sf):
    """p of every test, the exact ones of twenty sources included."""
    out = _documents_association(spark, sf, True)
    return out.select("outcome", "variable", "test", F.round("p_value", 4).alias("p_value"))


_ISO_VARIABLES = ("age_cut", "sexe", "age_sexe", "espece3", "serotype_flexneri", "labo", "voyage_01_m", "continent",
                  "year_real_cut")
_ISO_LONG = " UNION ALL ".join(
    f"SELECT '{d}' AS outcome, '{x}' AS variable, CAST({x} AS VARCHAR) AS level, {d}_SIR AS y FROM iso WHERE metrop"
    for d in fv.DESCRIBED_DRUGS for x in _ISO_VARIABLES)


@query(_association_sql(s.ANALYSIS, _ISO_LONG, "outcome, variable"))
def association_isolates(spark, sf):
    rows = v.isolates(spark, sf).where("metrop")
    out = asc.association(rows, _ISO_VARIABLES, {d: f"{d}_SIR" for d in fv.DESCRIBED_DRUGS}, p_values=False)
    return _rounded(out, "min_expected", "statistic")


@query(f"WITH {tests_sql.association_p(s.ANALYSIS, _ISO_LONG, 'outcome, variable', 12)} SELECT outcome, variable, test, round(p_value, 4) AS p_value FROM tested")
def association_isolates_p(spark, sf):
    rows = v.isolates(spark, sf).where("metrop")
    out = asc.association(rows, _ISO_VARIABLES, {d: f"{d}_SIR" for d in fv.DESCRIBED_DRUGS})
    return out.select("outcome", "variable", "test", F.round("p_value", 4).alias("p_value"))


def _all_tables_sql(x: str, y: str) -> str:
    """The exact test by enumeration of every table with the same margins."""
    choose = tests_sql.choose
    return f"""WITH RECURSIVE {s.OUT}, k AS (SELECT {x} AS x, count(*) AS n, sum({y}) AS e FROM outc WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1),
  a AS (SELECT list(n ORDER BY n, x) AS s, sum(e) AS m, sum(n) AS t, sum({choose('n', 'e')}) AS seen FROM k),
  st(i, total, v) AS (SELECT 0, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) UNION ALL
    SELECT i + 1, total + q.j, v + {choose('a.s[i + 1]', 'q.j')} FROM st, a, LATERAL (SELECT unnest(range(0, CAST(least(a.s[i + 1], a.m - total) AS BIGINT) + 1)) AS j) q
    WHERE i + 1 < len(a.s)),
  f AS (SELECT v + {choose('a.s[len(a.s)]', 'a.m - total')} AS v FROM st, a WHERE i + 1 = len(a.s) AND a.m - total BETWEEN 0 AND a.s[len(a.s)])
  SELECT '{x}' AS variable, CAST(a.t AS BIGINT) AS n, CAST(len(a.s) AS INTEGER) AS n_levels,
    (SELECT round(sum(exp(v - {choose('a.t', 'a.m')})), 6) FROM f WHERE v <= a.seen + 1e-7) AS p_value FROM a"""


@query(_all_tables_sql("lang", "toxic"))
def fisher_exact(spark, sf):
    """Exact test of language against toxicity."""
    return _rounded(asc.fisher_exact(v.labelled_documents(spark, sf), "lang", "toxic"), "p_value").drop("p_error")


@query(f"""WITH {s.OUT}, k AS (SELECT 'source' AS key, count(*) AS s, sum(toxic) AS e FROM outc WHERE source IS NOT NULL AND toxic IS NOT NULL GROUP BY source),
  {tests_sql.exact_p('k', 20)} SELECT key AS variable, (SELECT CAST(sum(s) AS BIGINT) FROM k) AS n, (SELECT CAST(count(*) AS INTEGER) FROM k) AS n_levels, round(p, 4) AS p_value, TRUE AS bounded FROM exact_p""")
def fisher_exact_large(spark, sf):
    """Twenty sources: many partial tables, whose values are rounded; the exact p lies within the bound of error."""
    out = asc.fisher_exact(v.labelled_documents(spark, sf), "source", "toxic")
    return out.select("variable", "n", "n_levels", F.round("p_value", 4).alias("p_value"), (F.col("p_error") < 0.2).alias("bounded"))


@query(f"""WITH {s.ANALYSIS}, c AS (SELECT ATB, year_real, count(*) AS n, sum(status) AS x FROM {_TESTED} WHERE metrop GROUP BY ALL),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ATB ORDER BY year_real) AS DOUBLE) AS s, sum(n) OVER (PARTITION BY ATB) AS nn, sum(x) OVER (PARTITION BY ATB) AS xx FROM c)
  SELECT ATB, CAST(count(*) AS INTEGER) AS n_scores, max(nn) AS n_tested, max(xx) AS n_resistant, round(pow(sum(s * (x - n * CAST(xx AS DOUBLE) / nn)), 2) /
  (max(CAST(xx AS DOUBLE) / nn) * (1 - max(CAST(xx AS DOUBLE) / nn)) * (sum(n * s * s) - pow(sum(n * s), 2) / max(nn))), 6) AS statistic FROM r GROUP BY ATB""")
def trend_test(spark, sf):
    counts = _counts(spark, sf, ["year_real"], F.col("metrop"))
    return _rounded(asc.trend_test(counts, "year_real", ["ATB"]), "statistic").drop("p_value")


@query(f"WITH base AS ({SQL['trend_test']}) SELECT ATB, n_scores, n_tested, n_resistant, statistic, "
       f"round({tests_sql.chi_tail('statistic', '1')}, 4) AS p_value FROM base")
def trend_test_p(spark, sf):
    return asc.trend_test(_counts(spark, sf, ["year_real"], F.col("metrop")), "year_real", ["ATB"]) \
        .withColumns({"statistic": F.round("statistic", 6), "p_value": F.round("p_value", 4)})


@query(f"WITH base AS ({SQL['chi_square']}) SELECT n, df, statistic, round({tests_sql.chi_tail('statistic', 'df')}, 4) AS p_value FROM base")
def chi_square_p(spark, sf):
    out = asc.chi_square(v.labelled_documents(spark, sf), "lang", "source")
    return out.select("n", "df", F.round("statistic", 6).alias("statistic"), F.round("p_value", 4).alias("p_value"))


# ---------------------------------------------------------------- regression

def _cohort(spark, sf, drug="CIP"):
    return cohort_from_table(v.isolates(spark, sf), drug)


_LEVELS = {"age_cut": Levels.of(fv.AGE_LEVELS, reference="15-49"),
           "year_real_cut": Levels.of(tuple(v.PERIODS), reference="1995_1996")}
_VARIABLES = fv.COHORTS["CIP"][1]
_UNI_LONG = " UNION ALL ".join(
    f"SELECT '{x}' AS variable, {x} AS level, CIP_SIR AS y, "
    + ("CASE age_cut WHEN '15-49' THEN 1 WHEN '< 15' THEN 2 ELSE 3 END" if x == "age_cut" else "1") + " AS pos FROM iso "
    f"WHERE metrop AND espece3 IN ('sonnei', 'flexneri') AND CIP_SIR IS NOT NULL AND {x} IS NOT NULL" for x in _VARIABLES)


@query(f"""WITH {s.ANALYSIS}, lng AS ({_UNI_LONG}),
  k AS (SELECT variable, level, pos, sum(y) AS a, count(*) - sum(y) AS b FROM lng GROUP BY ALL),
  w AS (SELECT *, row_number() OVER o AS level_rank, count(*) OVER (PARTITION BY variable) AS n_levels, first(level) OVER o AS reference, first(a) OVER o AS c,
    first(b) OVER o AS d, CAST(sum(a) OVER (PARTITION BY variable) AS DOUBLE) AS ev, CAST(sum(b) OVER (PARTITION BY variable) AS DOUBLE) AS ot FROM k WINDOW o AS (PARTITION BY variable ORDER BY pos, level)),
  g AS (SELECT *, sum(2 * (CASE WHEN a > 0 THEN a * ln(a * (ev + ot) / ((a + b) * ev)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b * (ev + ot) / ((a + b) * ot)) ELSE 0 END))
    OVER (PARTITION BY variable) AS lr FROM w)
  SELECT variable, reference, level, level_rank, n_levels, CAST(n_levels - 1 AS INTEGER) AS df, round(lr, 6) AS lr, least(a, b, c, d) <= 0 AS separated,
    round(CASE WHEN least(a, b, c, d) > 0 THEN a * d / CAST(b * c AS DOUBLE) END, 6) AS odds_ratio, round(CASE WHEN least(a, b, c, d) > 0 THEN sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d) END, 6) AS se
  FROM g WHERE level_rank > 1""")
def univariate_logit(spark, sf):
    out = logit.univariate_logit(_cohort(spark, sf), "status", _VARIABLES, _LEVELS)
    return _rounded(out, "lr", "odds_ratio", "se").drop("beta", "ci_low", "ci_high", "p_value")


@query(f"""WITH {s.OUT}, k AS (SELECT size, sum(quality) AS a, count(*) - sum(quality) AS b FROM outc GROUP BY size)
  SELECT 'size' AS variable, 'long' AS reference, 'short' AS level, round(CASE WHEN least(x.a, x.b, y.a, y.b) > 0 THEN x.a * y.b / CAST(x.b * y.a AS DOUBLE) END, 6) AS odds_ratio,
  round(CASE WHEN least(x.a, x.b, y.a, y.b) > 0 THEN sqrt(1.0 / x.a + 1.0 / x.b + 1.0 / y.a + 1.0 / y.b) END, 6) AS se FROM k x, k y WHERE x.size = 'short' AND y.size = 'long'""")
def univariate_logit_documents(spark, sf):
    out = logit.univariate_logit(v.labelled_documents(spark, sf), "quality", ["size"])
    return _rounded(out, "odds_ratio", "se").select("variable", "reference", "level", "odds_ratio", "se")


_UNI_CELLS = f"""lng AS ({_UNI_LONG}),
  k AS (SELECT variable, level, pos, sum(y) AS a, count(*) - sum(y) AS b FROM lng GROUP BY ALL),
  w AS (SELECT *, row_number() OVER o AS level_rank, count(*) OVER (PARTITION BY variable) AS n_levels, first(level) OVER o AS reference, first(a) OVER o AS c,
    first(b) OVER o AS d FROM k WINDOW o AS (PARTITION BY variable ORDER BY pos, level)),
  oc AS (SELECT * FROM w WHERE level_rank > 1)"""


@query(f"""WITH RECURSIVE {s.ANALYSIS}, {_UNI_CELLS}, {tests_sql.profile_2x2('oc')}, g AS ({SQL['univariate_logit']})
  SELECT g.*, round(exp(low), 4) AS ci_low, round(exp(high), 4) AS ci_high,
    round(CASE WHEN g.n_levels > 2 THEN {tests_sql.chi_tail('lr', 'g.df')} WHEN NOT separated THEN {tests_sql.chi_tail('pow(ln(odds_ratio) / se, 2)', '1')} END, 4) AS p_value
  FROM g JOIN oc ON oc.variable = g.variable AND oc.level = g.level LEFT JOIN profile_2x2 x ON x.a = oc.a AND x.b = oc.b AND x.c = oc.c AND x.d = oc.d""")
def univariate_logit_intervals(spark, sf):
    out = logit.univariate_logit(_cohort(spark, sf), "status", _VARIABLES, _LEVELS)
    out = _rounded(out, "lr", "odds_ratio", "se").drop("beta")
    return out.withColumns({c: F.round(c, 4) for c in ("ci_low", "ci_high", "p_value")})


@query()
def multivariable_logit(spark, sf):
    return logit.multivariable_logit(_cohort(spark, sf), "status", _VARIABLES, _LEVELS)


@query()
def multivariable_logit_documents(spark, sf):
    return logit.multivariable_logit(v.labelled_documents(spark, sf), "toxic", ["lang", "size", "quality"])


@query()
def profile_interval(spark, sf):
    return logit.profile_interval(v.labelled_documents(spark, sf), "quality", ["lang", "size"])


@query()
def term_lrt(spark, sf):
    return logit.term_lrt(_cohort(spark, sf), "status", _VARIABLES, _LEVELS)


@query()
def backward_aic(spark, sf):
    return logit.backward_aic(_cohort(spark, sf), "status", _VARIABLES, _LEVELS)


@query()
def screen_and_eliminate(spark, sf):
    return logit.screen_and_eliminate(_cohort(spark, sf), "status", _VARIABLES, _LEVELS, iterate=True)


@query()
def regression_table(spark, sf):
    return logit.regression_table(_cohort(spark, sf), "status", _VARIABLES, _LEVELS)


def _cohort_levels(drug: str) -> str:
    """Records and events per level among the complete records of a cohort."""
    species, variables = fv.COHORTS[drug]
    where = f"metrop AND espece3 IN ({', '.join(repr(x) for x in species)}) AND {drug}_SIR IS NOT NULL AND " + " AND ".join(
        f"{x} IS NOT NULL" for x in variables)
    return f"WITH {s.ANALYSIS} " + " UNION ALL ".join(
        f"SELECT '{x}' AS variable, CAST({x} AS VARCHAR) AS level, count(*) AS n, sum({drug}_SIR) AS n_events FROM iso WHERE {where} GROUP BY ALL"
        for x in variables)


def _cohort_report(spark, sf, drug):
    _, variables = fv.COHORTS[drug]
    levels = {k: lv for k, lv in _LEVELS.items() if k in variables}
    return logit.regression_table(_cohort(spark, sf, drug), "status", variables, levels)


@query()
def regression_table_macrolide(spark, sf):
    """The report of the macrolide cohort, with the year as a factor."""
    return _cohort_report(spark, sf, "AZM")


@query(_cohort_levels("AZM"))
def regression_levels_macrolide(spark, sf):
    out = _cohort_report(spark, sf, "AZM")
    return out.select("variable", "level", F.col("N").alias("n"), "n_events")


@query()
def regression_table_cephalosporin(spark, sf):
    """The report of the cephalosporin cohort, one species."""
    return _cohort_report(spark, sf, "C3G")


@query(_cohort_levels("C3G"))
def regression_levels_cephalosporin(spark, sf):
    out = _cohort_report(spark, sf, "C3G")
    return out.select("variable", "level", F.col("N").alias("n"), "n_events")


# ---------------------------------------------------------------- fits of two covariates, with an independent fit in SQL

_PAIR = ("sexe", "voyage_01")
_PAIR_ROWS = "metrop AND CIP_SIR IS NOT NULL AND sexe IS NOT NULL AND voyage_01 IS NOT NULL"
_PAIR_FIT = f"""{s.ANALYSIS}, pat AS (SELECT CAST(sexe = 'M' AS INTEGER) AS x1, CAST(voyage_01 = '1' AS INTEGER) AS x2, count(*) AS n, sum(CIP_SIR) AS y FROM iso WHERE {_PAIR_ROWS} GROUP BY ALL),
  {tests_sql.pair_fit('pat')}, terms AS (SELECT 1 AS j, 'sexe' AS variable, 'F' AS reference, 'M' AS level, b1 AS beta, sqrt(v1) AS se FROM pair_fit
    UNION ALL SELECT 2, 'voyage_01', '0', '1', b2, sqrt(v2) FROM pair_fit)"""
_LL = "sum(CASE WHEN y > 0 THEN y * ln(y / CAST(n AS DOUBLE)) ELSE 0 END + CASE WHEN n > y THEN (n - y) * ln(1 - y / CAST(n AS DOUBLE)) ELSE 0 END)"
#: Log-likelihoods of the smaller models are closed forms of their counts.
_PAIR_LL = f"""lls AS (SELECT (SELECT ll FROM pair_fit) AS ll12, (SELECT {_LL} FROM (SELECT sum(n) AS n, sum(y) AS y FROM pat GROUP BY x1)) AS ll1,
    (SELECT {_LL} FROM (SELECT sum(n) AS n, sum(y) AS y FROM pat GROUP BY x2)) AS ll2, (SELECT {_LL} FROM (SELECT sum(n) AS n, sum(y) AS y FROM pat)) AS ll0)"""
_DELETION = {1: "greatest(2 * (ll12 - ll2), 0)", 2: "greatest(2 * (ll12 - ll1), 0)"}
_ALONE = {1: "greatest(2 * (ll1 - ll0), 0)", 2: "greatest(2 * (ll2 - ll0), 0)"}


def _pair(spark, sf):
    """Two covariates, and a copy of the first that it determines."""
    rows = v.isolates(spark, sf).where(F.expr(_PAIR_ROWS))
    return rows.withColumn("sexe_copy", F.col("sexe"))


@query(f"""WITH RECURSIVE {_PAIR_FIT}, {tests_sql.pair_profile('pat')}
  SELECT variable, reference, level, round(beta, 5) AS beta, round(se, 5) AS se, round(exp(beta), 4) AS odds_ratio, round(exp(low), 4) AS ci_low, round(exp(high), 4) AS ci_high,
    round({tests_sql.chi_tail('pow(beta / se, 2)', '1')}, 4) AS wald_p, FALSE AS separated, FALSE AS aliased FROM terms JOIN pair_profile USING (j)
  UNION ALL SELECT 'sexe_copy', 'F', 'M', NULL, NULL, NULL, NULL, NULL, NULL, FALSE, TRUE""")
def multivariable_logit_pair(spark, sf):
    """Adjusted odds ratios with profile limits; a term that another one determines is aliased."""
    out = logit.multivariable_logit(_pair(spark, sf), "CIP_SIR", [*_PAIR, "sexe_copy"])
    out = out.withColumns({c: F.round(c, 5) for c in ("beta", "se")})
    return out.withColumns({c: F.round(c, 4) for c in ("odds_ratio", "ci_low", "ci_high", "wald_p")})


@query(f"""WITH RECURSIVE {_PAIR_FIT}, {tests_sql.pair_profile('pat')}
  SELECT variable, level, round(beta, 5) AS beta, round(beta - 1.959963984540054 * se, 5) AS wald_low, round(beta + 1.959963984540054 * se, 5) AS wald_high,
    round(low, 5) AS profile_low, round(high, 5) AS profile_high, 3.8415 AS rise_low, 3.8415 AS rise_high FROM terms JOIN pair_profile USING (j)""")
def profile_interval_pair(spark, sf):
    """Profile limits, and the rise of the deviance there by a second fit."""
    out = logit.profile_interval(_pair(spark, sf), "CIP_SIR", _PAIR)
    out = out.withColumns({c: F.round(c, 5) for c in ("beta", "wald_low", "wald_high", "profile_low", "profile_high")})
    return out.withColumns({c: F.round(c, 4) for c in ("rise_low", "rise_high")})


@query(f"""WITH RECURSIVE {_PAIR_FIT}, {_PAIR_LL}, t AS (SELECT 'sexe' AS variable, {_DELETION[1]} AS lr FROM lls UNION ALL SELECT 'voyage_01', {_DELETION[2]} FROM lls)
  SELECT variable, 1 AS df, round(lr, 5) AS lr, round({tests_sql.chi_tail('lr', '1')}, 4) AS p_value FROM t""")
def term_lrt_pair(spark, sf):
    out = logit.term_lrt(_pair(spark, sf), "CIP_SIR", _PAIR)
    return out.withColumns({"lr": F.round("lr", 5), "p_value": F.round("p_value", 4)})


@query(f"""WITH RECURSIVE {_PAIR_FIT}, {_PAIR_LL}, a AS (SELECT 6 - 2 * ll12 AS a12, 4 - 2 * ll1 AS a1, 4 - 2 * ll2 AS a2, 2 - 2 * ll0 AS a0, * FROM lls)
  SELECT 0 AS step, NULL AS removed, 'sexe,voyage_01' AS variables, round(a12, 5) AS aic, round(-2 * ll12, 5) AS deviance FROM a
  UNION ALL SELECT 1, CASE WHEN a2 <= a1 THEN 'sexe' ELSE 'voyage_01' END, CASE WHEN a2 <= a1 THEN 'voyage_01' ELSE 'sexe' END, round(least(a1, a2), 5), round(-2 * greatest(ll1, ll2), 5)
    FROM a WHERE least(a1, a2) < a12
  UNION ALL SELECT 2, CASE WHEN a2 <= a1 THEN 'voyage_01' ELSE 'sexe' END, '', round(a0, 5), round(-2 * ll0, 5) FROM a WHERE least(a1, a2) < a12 AND a0 < least(a1, a2)""")
def backward_aic_pair(spark, sf):
    out = logit.backward_aic(_pair(spark, sf), "CIP_SIR", _PAIR)
    return out.withColumns({"aic": F.round("aic", 5), "deviance": F.round("deviance", 5)})


def _screen_sql(p_in: float, p_out: float) -> str:
    wald = {j: f"(SELECT {tests_sql.chi_tail('pow(ln(a * d / (b * c)), 2) / (1 / a + 1 / b + 1 / c + 1 / d)', '1')} FROM two WHERE j = {j})" for j in (1, 2)}
    return f"""WITH RECURSIVE {_PAIR_FIT}, {_PAIR_LL},
  two AS (SELECT j, CAST(sum(y) FILTER (x = 1) AS DOUBLE) AS a, CAST(sum(n - y) FILTER (x = 1) AS DOUBLE) AS b, CAST(sum(y) FILTER (x = 0) AS DOUBLE) AS c, CAST(sum(n - y) FILTER (x = 0) AS DOUBLE) AS d
    FROM (SELECT 1 AS j, x1 AS x, n, y FROM pat UNION ALL SELECT 2, x2, n, y FROM pat) GROUP BY j),
  lr AS (SELECT {', '.join(f'{_DELETION[j]} AS x{j}, {_ALONE[j]} AS z{j}' for j in (1, 2))} FROM lls),
  p AS (SELECT {', '.join(f"{wald[j]} AS c{j}, {tests_sql.chi_tail(f'x{j}', '1')} AS d{j}, {tests_sql.chi_tail(f'z{j}', '1')} AS s{j}" for j in (1, 2))} FROM lr),
  k AS (SELECT *, c1 < {p_in} AS k1, c2 < {p_in} AS k2 FROM p), rows AS (
  SELECT 0 AS step, 'screen' AS stage, 'sexe' AS variable, c1 AS p, k1 AS kept FROM k UNION ALL SELECT 0, 'screen', 'voyage_01', c2, k2 FROM k
  UNION ALL SELECT 1, 'deletion', 'sexe', d1, NOT (d1 >= d2 AND d1 >= {p_out}) FROM k WHERE k1 AND k2
  UNION ALL SELECT 1, 'deletion', 'voyage_01', d2, NOT (d2 > d1 AND d2 >= {p_out}) FROM k WHERE k1 AND k2
  UNION ALL SELECT 2, 'deletion', CASE WHEN d1 >= d2 THEN 'voyage_01' ELSE 'sexe' END, CASE WHEN d1 >= d2 THEN s2 ELSE s1 END, CASE WHEN d1 >= d2 THEN s2 ELSE s1 END < {p_out}
    FROM k WHERE k1 AND k2 AND greatest(d1, d2) >= {p_out}
  UNION ALL SELECT 1, 'deletion', CASE WHEN k1 THEN 'sexe' ELSE 'voyage_01' END, CASE WHEN k1 THEN s1 ELSE s2 END, CASE WHEN k1 THEN s1 ELSE s2 END < {p_out} FROM k WHERE k1 <> k2)
  SELECT step, stage, variable, round(p, 4) AS p_value, kept FROM rows"""


def _screened(spark, sf, p_in, p_out):
    out = logit.screen_and_eliminate(_pair(spark, sf), "CIP_SIR", _PAIR, p_in=p_in, p_out=p_out, iterate=True)
    return out.withColumn("p_value", F.round("p_value", 4))


@query(_screen_sql(0.25, 0.05))
def screen_and_eliminate_pair(spark, sf):
    return _screened(spark, sf, 0.25, 0.05)


@query(_screen_sql(1.1, 0.05))
def screen_and_eliminate_all(spark, sf):
    """Every covariate passes the screen, so the eliminations show."""
    return _screened(spark, sf, 1.1, 0.05)


@query(f"""WITH RECURSIVE {_PAIR_FIT}, {_PAIR_LL}, {tests_sql.pair_profile('pat')},
  lv AS (SELECT 1 AS j, x1 AS x, sum(n) AS n, sum(y) AS x_events FROM pat GROUP BY x1 UNION ALL SELECT 2, x2, sum(n), sum(y) FROM pat GROUP BY x2),
  counts AS (SELECT x_events AS x, n FROM lv), {tests_sql.exact_limits('counts')},
  oc AS (SELECT u.j, CAST(u.x_events AS DOUBLE) AS a, CAST(u.n - u.x_events AS DOUBLE) AS b, CAST(r.x_events AS DOUBLE) AS c, CAST(r.n - r.x_events AS DOUBLE) AS d FROM lv u JOIN lv r ON u.j = r.j AND u.x = 1 AND r.x = 0),
  {tests_sql.profile_2x2('oc')},
  crude AS (SELECT oc.j, {tests_sql.interval('exp(ln(oc.a * oc.d / (oc.b * oc.c)))', 'exp(f.low)', 'exp(f.high)')} AS text,
    {tests_sql.chi_tail('pow(ln(oc.a * oc.d / (oc.b * oc.c)), 2) / (1 / oc.a + 1 / oc.b + 1 / oc.c + 1 / oc.d)', '1')} AS p
    FROM oc LEFT JOIN profile_2x2 f ON f.a = oc.a AND f.b = oc.b AND f.c = oc.c AND f.d = oc.d),
  del AS (SELECT 1 AS j, {tests_sql.chi_tail('x', '1')} AS p FROM (SELECT {_DELETION[1]} AS x FROM lls) UNION ALL SELECT 2, {tests_sql.chi_tail('x', '1')} FROM (SELECT {_DELETION[2]} AS x FROM lls)),
  adj AS (SELECT j, {tests_sql.interval('exp(beta)', 'exp(low)', 'exp(high)')} AS text FROM terms JOIN pair_profile USING (j))
  SELECT lv.j AS variable_rank, t.variable, lv.x + 1 AS level_rank, CASE lv.x WHEN 0 THEN t.reference ELSE t.level END AS level, CAST(lv.n AS BIGINT) AS N, CAST(x_events AS BIGINT) AS n_events,
    {tests_sql.interval('100.0 * (x_events / CAST(lv.n AS DOUBLE))', '100.0 * e.low', '100.0 * e.high')} AS perc,
    CASE lv.x WHEN 0 THEN '1' ELSE crude.text END AS crude_or, CASE lv.x WHEN 0 THEN {tests_sql.p_text('crude.p')} END AS crude_p,
    CASE lv.x WHEN 0 THEN '1' ELSE adj.text END AS adjusted_or, CASE lv.x WHEN 0 THEN {tests_sql.p_text('del.p')} END AS adjusted_p
  FROM lv JOIN terms t USING (j) JOIN crude USING (j) JOIN del USING (j) JOIN adj USING (j) JOIN exact_limits e ON e.x = lv.x_events AND e.n = lv.n""")
def regression_table_pair(spark, sf):
    """The whole report as text: percentages with exact limits, crude and adjusted odds ratios with profile limits, both p."""
    return logit.regression_table(_pair(spark, sf), "CIP_SIR", _PAIR, p_in=1.1, p_out=1.1)


# ---------------------------------------------------------------- functions per group

@query(f"""WITH {s.ANALYSIS}, c AS (SELECT ATB, year_real, count(*) AS n, sum(status) AS x FROM {_TESTED} WHERE metrop GROUP BY ALL)
  SELECT ATB, count(*) AS n_years, round(regr_slope(100.0 * x / n, year_real), 6) AS slope, round(regr_r2(100.0 * x / n, year_real), 6) AS r2,
    CAST(arg_max(year_real, x / CAST(n AS DOUBLE)) AS INTEGER) AS peak FROM c GROUP BY ATB""")
def yearly_slopes(spark, sf):
    """A least-squares line through each drug's yearly percentages: a function of one group's few counted rows."""
    counts = _counts(spark, sf, ["year_real"], F.col("metrop"))
    out = reshape.group_function(counts, ["ATB"], yearly_line, "ATB string, n_years long, slope double, r2 double, peak int")
    return _rounded(out, "slope", "r2")
