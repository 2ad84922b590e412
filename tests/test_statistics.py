"""Closed forms, brute force and properties for the tests and the regression."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from vigilar.functions import special as sp
from vigilar.functions.levels import Levels
from vigilar.operators import association as asc
from vigilar.operators import exact
from vigilar.operators import logit
from vigilar.sources.tables import literal_table


def test_chi_square_tail_closed_forms():
    x = np.array([0.1, 1.0, 3.841458820694124, 20.0])
    assert np.allclose(sp.chi2_tail(x, np.full(4, 2)), np.exp(-x / 2))
    assert np.allclose(sp.chi2_tail(x, np.full(4, 1)), [math.erfc(math.sqrt(v / 2)) for v in x])
    assert np.allclose(sp.chi2_tail(x, np.full(4, 4)), np.exp(-x / 2) * (1 + x / 2))
    assert sp.chi2_tail(np.array([0.0]), np.array([5]))[0] == 1.0
    assert np.isnan(sp.chi2_tail(np.array([np.nan]), np.array([1]))[0])


@pytest.mark.parametrize("n", [1, 10, 1000, 10**7])
def test_exact_limits_at_the_ends(n):
    low, high = sp.exact_binomial_limits(np.array([0, n]), np.array([n, n]))
    assert low[0] == 0 and math.isclose(high[0], 1 - 0.025 ** (1 / n), rel_tol=1e-9)
    assert high[1] == 1 and math.isclose(low[1], 0.025 ** (1 / n), rel_tol=1e-9)


@given(st.integers(1, 60), st.data())
@settings(max_examples=40, deadline=None)
def test_exact_limits_have_their_tails(n, data):
    x = data.draw(st.integers(0, n))
    low, high = sp.exact_binomial_limits(np.array([x]), np.array([n]))
    def tail(p, ks):
        return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in ks)
    if x > 0:
        assert math.isclose(tail(low[0], range(x, n + 1)), 0.025, rel_tol=1e-6)
    if x < n:
        assert math.isclose(tail(high[0], range(0, x + 1)), 0.025, rel_tol=1e-6)


def test_exact_limits_without_counts():
    low, high = sp.exact_binomial_limits(np.array([0.0, np.nan]), np.array([0.0, 3.0]))
    assert np.isnan(low).all() and np.isnan(high).all()


def test_limits_of_very_large_counts():
    """One method for all sizes: mirrored counts give mirrored limits, and few events among many are Poisson."""
    for k in (1, 7, 40):
        n = 10.0 ** np.arange(3, 14)
        low, high = sp.exact_binomial_limits(np.full(n.shape, float(k)), n)
        rest_low, rest_high = sp.exact_binomial_limits(n - k, n)
        assert np.allclose(low, 1 - rest_high, rtol=1e-6, atol=1e-15) and np.allclose(high, 1 - rest_low, rtol=1e-6, atol=1e-15)
        def below(mean, upto):
            return sum(math.exp(-mean + j * math.log(mean) - math.lgamma(j + 1)) for j in range(upto + 1))
        assert math.isclose(1 - below(low[-1] * n[-1], k - 1), 0.025, rel_tol=1e-6)
        assert math.isclose(below(high[-1] * n[-1], k), 0.025, rel_tol=1e-6)


def brute_force_fisher(events, others):
    sizes, m = [e + o for e, o in zip(events, others)], sum(events)
    def weight(k):
        return math.prod(math.comb(s, x) for s, x in zip(sizes, k))
    seen = weight(events)
    tables = [k for k in itertools.product(*[range(s + 1) for s in sizes]) if sum(k) == m]
    return sum(weight(k) for k in tables if weight(k) <= seen * (1 + 1e-7)) / math.comb(sum(sizes), m)


def exact_rows(spark, tables):
    """{key: (p, bound of error)} of r x 2 tables {key: [(n1, n0), ...]}."""
    cells = literal_table(spark, [(k, e, o) for k, rows in tables.items() for e, o in rows], "k string, n1 long, n0 long")
    return {r["k"]: (r["p_value"], r["p_error"]) for r in exact.exact_p(cells, ["k"]).collect()}


def test_exact_test_against_all_tables(spark):
    rng = np.random.default_rng(11)
    tables = {f"t{i}": [tuple(map(int, rng.integers(0, 6, 2))) for _ in range(rng.integers(2, 5))] for i in range(120)}
    tables |= {"ones": [(1, 0), (0, 1), (1, 0), (3, 4), (0, 1)], "only ones": [(1, 0), (0, 1), (1, 0)], "two": [(3, 9), (90, 80)], None: [(1, 3), (4, 1)]}
    got = exact_rows(spark, tables)
    for k, rows in tables.items():
        filled = [(e, o) for e, o in rows if e + o]
        events, others = zip(*filled) if filled else ((), ())
        if len(filled) < 2 or not sum(events) or not sum(others):
            assert k not in got
        else:
            p, bound = got[k]
            assert math.isclose(p, brute_force_fisher(events, others), rel_tol=1e-7), k
            assert 0 <= bound < 1e-6


def test_exact_test_on_large_tables(spark, monkeypatch):
    rng = np.random.default_rng(1)
    wide = [tuple(map(int, x)) for x in zip(rng.integers(0, 4, 7), rng.integers(3, 7, 7))]
    tables = {"sure": [(2, 1), (500, 600), (400, 700), (300, 200)], "giant": [(1, 2), (4_000_000, 9_000_000)],
              "names": [(1, 0)] * 30 + [(0, 1)] * 400 + [(2, 0), (1, 2)], "wide": wide}
    got = exact_rows(spark, tables)
    assert 0 <= got["sure"][0] < 1e-10
    assert math.isclose(got["giant"][0], 1.0, abs_tol=1e-6)
    p = brute_force_fisher(*zip(*wide))
    assert math.isclose(got["wide"][0], p, rel_tol=1e-7)
    monkeypatch.setattr(exact, "FEW", 1)  # all partial tables in coarse steps: the bound still holds the exact p
    rough, bound = exact_rows(spark, {"wide": wide})["wide"]
    assert abs(rough - p) <= bound < 0.05


def test_association_gathers_no_cells(spark):
    """Neither the choice nor the exact test packs a variable's levels into one row."""
    df = literal_table(spark, [(f"name {i}", i % 3, i % 2) for i in range(60)], "a string, b int, y int")
    plan = asc.association(df, ["a", "b"], {"y": "y"})._jdf.queryExecution().toString()
    choice = asc.association(df, ["a", "b"], {"y": "y"}, p_values=False)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "collect_list" not in choice and "Python" not in choice


def test_chi_square_against_the_full_grid(spark):
    cells = {("a", 0): 10, ("a", 1): 20, ("b", 0): 30, ("b", 2): 5, ("c", 1): 7, ("c", 2): 9}
    df = literal_table(spark, [(x, y, n) for (x, y), n in cells.items()] + [(None, 1, 4), ("a", None, 2)],
                       "x string, y int, n long")
    got = asc.chi_square(df, "x", "y", weight="n").first()
    grid = np.array([[cells.get((x, y), 0) for y in (0, 1, 2)] for x in "abc"], float)
    e = grid.sum(1, keepdims=True) * grid.sum(0) / grid.sum()
    assert math.isclose(got["statistic"], ((grid - e) ** 2 / e).sum(), rel_tol=1e-9)
    assert math.isclose(got["min_expected"], e.min()) and got["df"] == 4 and got["n"] == 81
    assert math.isclose(got["p_value"], sp.chi2_tail(np.array([got["statistic"]]), np.array([4]))[0])


def test_correction_is_for_two_by_two(spark):
    df = literal_table(spark, [("a", 0, 8), ("a", 1, 4), ("b", 0, 5), ("b", 1, 9)], "x string, y int, n long")
    grid = np.array([[8, 4], [5, 9]], float)
    e = grid.sum(1, keepdims=True) * grid.sum(0) / grid.sum()
    want = ((np.abs(grid - e) - 0.5) ** 2 / e).sum()
    assert math.isclose(asc.chi_square(df, "x", "y", yates=True, weight="n").first()["statistic"], want, rel_tol=1e-9)


def test_association_chooses_the_test(spark):
    def block(v, cells):
        return [(v, lv, y) for lv, (n1, n0) in cells.items() for y, n in ((1, n1), (0, n0)) for _ in range(n)]
    rows = {"big": {"a": (20, 30), "b": (25, 25)}, "mid": {"a": (4, 6), "b": (5, 5)}, "small": {"a": (1, 6), "b": (4, 2)}}
    for v, cells in rows.items():
        df = literal_table(spark, [(lv, y) for _, lv, y in block(v, cells)] + [(None, 1), ("a", None)], "v string, y int")
        got = asc.association(df, ["v"], {"r": "y"}).first()
        (a, b), (c, d) = cells["a"], cells["b"]
        assert got["test"] == {"big": "chisq", "mid": "chisq corr", "small": "fisher"}[v]
        assert got["n"] == a + b + c + d and got["n_levels"] == 2
        if v == "small":
            assert math.isclose(got["p_value"], brute_force_fisher((a, c), (b, d)), rel_tol=1e-9)
    df = literal_table(spark, [(lv, y) for _, lv, y in block("big", rows["big"])], "v string, y int")
    listed = asc.association(df, ["v"], {"r": "y"}, levels={"v": Levels.of(("a", "b", "c"))}).first()
    assert listed["test"] == "fisher" and listed["min_expected"] == 0
    single = asc.association(df.where("y = 1"), ["v"], {"r": "y"}).first()
    assert single["p_value"] is None


def test_trend_does_not_depend_on_the_score_origin(spark):
    data = [(2005, 100, 10), (2006, 120, 18), (2007, 90, 20), (2009, 110, 25)]
    df = literal_table(spark, data, "year int, n_tested long, n_resistant long")
    got = asc.trend_test(df, "year").first()
    n, x = np.array([d[1] for d in data], float), np.array([d[2] for d in data], float)
    for s in (np.arange(4.0), np.arange(1.0, 5.0)):
        p = x.sum() / n.sum()
        want = ((s * (x - n * p)).sum()) ** 2 / (p * (1 - p) * ((n * s * s).sum() - (n * s).sum() ** 2 / n.sum()))
        assert math.isclose(got["statistic"], want, rel_tol=1e-9)
    flat = df.withColumn("n_resistant", F.lit(0).cast("long"))
    assert asc.trend_test(flat, "year").first()["statistic"] is None


# ---------------------------------------------------------------- regression

@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 3, 900), rng.integers(0, 2, 900), rng.integers(0, 4, 900)
    p = 1 / (1 + np.exp(-(-0.7 + 0.5 * (a == 1) - 0.6 * (a == 2) + 0.8 * b)))
    y = (rng.random(900) < p).astype(int)
    rows = [(int(t), "xyz"[i], "mn"[j], None if k == 3 and t else "pqrs"[k]) for t, i, j, k in zip(y, a, b, c)]
    return literal_table(spark, rows, "y int, a string, b string, c string").repartition(5)


def dummies(df):
    return df.select(
        F.col("y").cast("double").alias("label"), *[(F.col("a") == v).cast("double").alias(f"a{v}") for v in "yz"],
        (F.col("b") == "n").cast("double").alias("bn"))


def test_fit_equals_row_level_glm(spark, cohort):
    got = {(r["variable"], r["level"]): r for r in logit.multivariable_logit(cohort, "y", ["a", "b"]).collect()}
    data = VectorAssembler(inputCols=["ay", "az", "bn"], outputCol="features").transform(dummies(cohort))
    model = GeneralizedLinearRegression(family="binomial", tol=1e-12, maxIter=50).fit(data)
    errors = model.summary.coefficientStandardErrors
    for i, key in enumerate([("a", "y"), ("a", "z"), ("b", "n")]):
        assert math.isclose(got[key]["beta"], model.coefficients[i], rel_tol=1e-6)
        assert math.isclose(got[key]["se"], errors[i], rel_tol=1e-5)
    frame = logit.model_frame(cohort, "y", ["a", "b"])
    fit = logit.fit_models(frame, [["a", "b"]])[0]
    assert math.isclose(fit.deviance, model.summary.deviance, rel_tol=1e-8)
    assert math.isclose(fit.aic, model.summary.aic, rel_tol=1e-8)


def test_score_equations_hold(cohort):
    frame = logit.model_frame(cohort, "y", ["a", "b", "c"])
    fit = logit.fit_models(frame, [["a", "b", "c"]])[0]
    _, score, _ = logit._likelihood_sums(frame, fit.beta[None, :], [fit.columns])[0]
    assert np.abs(score).max() < 1e-5


def test_deviance_falls_with_terms_and_layout_does_not_matter(cohort):
    frame = logit.model_frame(cohort, "y", ["a", "b", "c"])
    fits = logit.fit_models(frame, [[], ["a"], ["a", "b"], ["a", "b", "c"]])
    deviances = [f.deviance for f in fits]
    assert deviances == sorted(deviances, reverse=True)
    other = logit.model_frame(cohort.repartition(3).orderBy("b"), "y", ["a", "b", "c"])
    assert math.isclose(logit.fit_models(other, [["a", "b", "c"]])[0].deviance, deviances[-1], rel_tol=1e-10)


def test_profile_limits_sit_on_the_drop(cohort):
    frame = logit.model_frame(cohort, "y", ["a", "b"])
    fit = logit.fit_models(frame, [["a", "b"]])[0]
    limits = logit.profile_limits(frame, fit)
    rows = frame.labelled.collect()
    x = np.array([[1, r["a"] == "y", r["a"] == "z", r["b"] == "n"] for r in rows], float)
    y, n = np.array([r["y"] for r in rows], float), np.array([r["n"] for r in rows], float)
    for j, pair in limits.items():
        assert pair[0] < fit.beta[j] < pair[1]
        for value in pair:
            beta, free = fit.beta.copy(), [k for k in range(4) if k != j]
            beta[j] = value
            for _ in range(60):
                mu = 1 / (1 + np.exp(-x @ beta))
                w = n * mu * (1 - mu)
                beta[free] += np.linalg.solve(x[:, free].T * w @ x[:, free], x[:, free].T @ (y - n * mu))
            loglik = (y * (x @ beta) - n * np.logaddexp(0, x @ beta)).sum()
            assert math.isclose(2 * (fit.loglik - loglik), 3.841458820694124, rel_tol=1e-4)


def test_univariate_closed_form_is_the_fit(cohort):
    crude = {r["level"]: r for r in logit.univariate_logit(cohort, "y", ["a"]).collect()}
    fitted = {r["level"]: r for r in logit.multivariable_logit(cohort, "y", ["a"]).collect()}
    lrt = logit.term_lrt(cohort, "y", ["a"]).first()
    for level in "yz":
        for name in ("beta", "se", "odds_ratio", "ci_low", "ci_high"):
            assert math.isclose(crude[level][name], fitted[level][name], rel_tol=1e-5)
        assert math.isclose(crude[level]["lr"], lrt["lr"], rel_tol=1e-6)
        assert math.isclose(crude[level]["p_value"], lrt["p_value"], rel_tol=1e-6)
    two = logit.univariate_logit(cohort, "y", ["b"]).first()
    assert math.isclose(two["p_value"], math.erfc(abs(two["beta"] / two["se"]) / math.sqrt(2)), rel_tol=1e-9)


def test_known_odds_ratio(spark):
    df = literal_table(spark, [("short", 1, 44), ("short", 0, 3), ("long", 1, 297), ("long", 0, 55)], "size string, y int, n int")
    got = logit.univariate_logit(df, "y", ["size"], {"size": Levels.of(("short", "long"))}, weight="n").first()
    assert (got["reference"], got["level"]) == ("short", "long")
    assert math.isclose(got["odds_ratio"], 0.36818, abs_tol=5e-6)
    assert math.isclose(got["se"], 0.61450, abs_tol=5e-6) and math.isclose(got["lr"], 3.40965, abs_tol=5e-6)


def test_separation_is_flagged(spark):
    df = literal_table(spark, [("a", 1, 5), ("a", 0, 5), ("b", 0, 8), ("c", 1, 3), ("c", 0, 6)], "v string, y int, n int")
    crude = {r["level"]: r for r in logit.univariate_logit(df, "y", ["v"], weight="n").collect()}
    assert crude["b"]["separated"] and crude["b"]["odds_ratio"] is None and not crude["c"]["separated"]
    frame = logit.model_frame(df, "y", ["v"], weight="n")
    fitted = {r["level"]: r for r in logit.multivariable_logit(df, "y", ["v"], frame=frame).collect()}
    assert fitted["b"]["separated"] and fitted["b"]["ci_low"] is None


def pairs(spark, cells, names):
    return literal_table(spark, [(*k, y, n) for k, (a, b) in cells.items() for y, n in ((1, a), (0, b)) if n],
                         ", ".join(f"{c} string" for c in names) + ", y int, n int")


def test_aliased_terms_are_dropped(spark):
    df = pairs(spark, {("p", "p"): (25, 22), ("q", "q"): (10, 30)}, ["v", "w"])
    frame = logit.model_frame(df, "y", ["v", "w"], weight="n")
    got = {r["variable"]: r for r in logit.multivariable_logit(df, "y", ["v", "w"], frame=frame).collect()}
    alone = logit.multivariable_logit(df, "y", ["v"], frame=logit.model_frame(df, "y", ["v"], weight="n")).first()
    assert math.isclose(got["v"]["beta"], alone["beta"], rel_tol=1e-8) and math.isclose(got["v"]["beta"], -1.226, abs_tol=1e-3)
    assert not got["v"]["aliased"] and got["w"]["aliased"] and got["w"]["beta"] is None and got["w"]["ci_low"] is None
    assert math.isclose(got["v"]["ci_low"], alone["ci_low"], rel_tol=1e-5)
    for r in logit.term_lrt(df, "y", ["v", "w"], frame=frame).collect():
        assert r["df"] == 0 and r["p_value"] is None
    fit = logit.fit_models(frame, [["v", "w"]])[0]
    assert math.isclose(fit.aic, fit.deviance + 4, rel_tol=1e-12)


def test_a_separated_level_leaves_the_other_limits(spark):
    df = pairs(spark, {("p", "a"): (25, 12), ("p", "b"): (0, 10), ("q", "a"): (10, 20), ("q", "b"): (0, 10)}, ["v", "w"])
    frame = logit.model_frame(df, "y", ["v", "w"], weight="n")
    got = {r["variable"]: r for r in logit.multivariable_logit(df, "y", ["v", "w"], frame=frame).collect()}
    kept = df.where("w = 'a'")
    alone = logit.multivariable_logit(kept, "y", ["v"], frame=logit.model_frame(kept, "y", ["v"], weight="n")).first()
    assert got["w"]["separated"] and got["w"]["ci_low"] is None
    for c in ("beta", "ci_low", "ci_high"):
        assert math.isclose(got["v"][c], alone[c], rel_tol=1e-4)


def test_a_rare_outcome_keeps_its_limits(spark):
    df = pairs(spark, {("p",): (12, 10_000_000), ("q",): (30, 1_666_666)}, ["v"])
    got = logit.multivariable_logit(df, "y", ["v"], frame=logit.model_frame(df, "y", ["v"], weight="n")).first()
    crude = logit.univariate_logit(df, "y", ["v"], weight="n").first()
    assert not got["separated"] and math.isclose(got["odds_ratio"], 15.0, rel_tol=1e-4)
    assert math.isclose(got["ci_low"], crude["ci_low"], rel_tol=1e-4) and math.isclose(got["ci_high"], crude["ci_high"], rel_tol=1e-4)


def test_running_out_of_steps_is_an_error(cohort, monkeypatch):
    monkeypatch.setattr(logit, "MAX_STEPS", 2)
    with pytest.raises(ArithmeticError):
        logit.fit_models(logit.model_frame(cohort, "y", ["a", "b"]), [["a", "b"]])


def test_selection(cohort):
    path = logit.backward_aic(cohort, "y", ["a", "b", "c"]).orderBy("step").collect()
    aics = [r["aic"] for r in path]
    assert aics == sorted(aics, reverse=True) and {"a", "b"} <= set(path[-1]["variables"].split(","))
    steps = logit.screen_and_eliminate(cohort, "y", ["a", "b"]).collect()
    assert all(r["kept"] for r in steps)


def test_report(cohort):
    table = logit.regression_table(cohort, "y", ["a", "b"]).collect()
    first = [r for r in table if r["level_rank"] == 1]
    assert [r["variable"] for r in first] == ["a", "b"]
    assert all(r["crude_or"] == "1" and r["adjusted_or"] == "1" and r["crude_p"] for r in first)
    assert all(r["crude_p"] is None and "(" in r["adjusted_or"] for r in table if r["level_rank"] > 1)
