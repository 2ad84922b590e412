"""Logistic regression on counted covariate patterns.

The one pass over the records counts every combination of the categorical covariates. The
small pattern table is checkpointed; each Newton step is one Spark job over it, in which
every partition adds up log-likelihood, score and information of *all* models being fitted,
and only those sums (their size depends on the number of coefficients alone) reach the
driver. Since the binomial log-likelihood of grouped data without its constant is the
record-level one, deviances and AIC are record-level values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import format_ci, format_p
from ..functions.levels import Levels
from ..functions.special import (
    CHI2_95_1, Z975, chi2_sf, chi2_tail, normal_two_sided, profile_limits_2x2, wald_p)
from ..sources.tables import cut_lineage, literal_table
from .aggregate import beside
from .ordering import number_in_order
from .prevalence import level_counts, with_exact_interval

MAX_LEVELS = 500  # default bound of a model's levels: their squared number of sums reaches the driver
MAX_STEPS = 500  # far beyond any fit; running out of steps is an error, never a result
DRIFT = 1e-3  # a coefficient that still moves by this much when the likelihood stands still has no finite estimate
ALIASED = 1e-9  # share of a column that earlier columns leave unexplained, below which it is a combination of them


@dataclass
class ModelFrame:
    """Counted patterns of complete records: level codes, events ``y``, records ``n``."""

    patterns: DataFrame
    variables: tuple[str, ...]
    levels: dict[str, tuple[str, ...]]  # reference level first
    labelled: DataFrame = field(repr=False, default=None)

    @property
    def terms(self) -> list[tuple[str, str]]:
        """Dummy-coded terms in order, after the intercept."""
        return [(v, lv) for v in self.variables for lv in self.levels[v][1:]]

    def columns(self, variables: Sequence[str]) -> np.ndarray:
        """Design columns (0 is the intercept) of a model with these variables."""
        keep = [0] + [i + 1 for i, (v, _) in enumerate(self.terms) if v in variables]
        return np.array(keep, dtype=int)


def model_frame(df: DataFrame, outcome: str, variables: Sequence[str],
                levels: Mapping[str, Levels] | None = None, weight: str | None = None,
                max_levels: int = MAX_LEVELS) -> ModelFrame:
    """Count the covariate patterns of the complete records. More than ``max_levels`` levels per variable is an error.

    Levels not given are the values found, in sort order; the first is the reference. Levels
    without a record are left out.
    """
    variables = tuple(variables)
    complete = df.na.drop(subset=[outcome, *variables])
    for v, lv in (levels or {}).items():
        if v in variables:
            complete = complete.where(F.col(v).cast("string").isin(list(lv.values)))
    size = F.lit(1) if weight is None else F.col(weight)
    labelled = cut_lineage(
        complete.groupBy(*[F.col(v).cast("string").alias(v) for v in variables])
        .agg(F.sum(size * F.col(outcome).cast("long")).alias("y"), F.sum(size).cast("long").alias("n")))
    packed = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("level")) for v in variables])
    found: dict[str, list[str]] = {v: [] for v in variables}
    limit = max_levels * len(variables) + 1
    seen = labelled.select(F.inline(packed)).distinct().limit(limit).collect()
    if len(seen) == limit:
        raise ValueError(f"more than {max_levels} levels per variable: raise max_levels if they are meant to be covariates")
    for row in seen:
        found[row["variable"]].append(row["level"])
    ordered = {}
    for v in variables:
        wanted = levels[v].ordered if levels and v in levels else sorted(found[v])
        ordered[v] = tuple(lv for lv in wanted if lv in found[v])
    codes = [
        (F.array_position(F.array(*[F.lit(lv) for lv in ordered[v]]), F.col(v)) - 1).cast("int").alias(f"c{i}")
        for i, v in enumerate(variables)]
    return ModelFrame(labelled.select(*codes, "y", "n"), variables, ordered, labelled)


@dataclass
class Fit:
    """Fitted coefficients on the full design; excluded ones are 0.

    ``columns`` are the estimated ones: a column that earlier ones already determine is in ``aliased`` instead. A
    ``separated`` one has no finite estimate: the likelihood rises for ever in its direction.
    """

    columns: np.ndarray
    beta: np.ndarray
    covariance: np.ndarray
    loglik: float
    aliased: np.ndarray
    separated: frozenset[int]

    @property
    def deviance(self) -> float:
        return -2.0 * self.loglik

    @property
    def aic(self) -> float:
        return self.deviance + 2.0 * len(self.columns)


def _likelihood_sums(frame: ModelFrame, betas: np.ndarray, models: list[np.ndarray]):
    """One Spark job: log-likelihood, score and information of every coefficient vector."""
    sizes = [len(frame.levels[v]) for v in frame.variables]
    width = betas.shape[1]
    coefficients, used = betas.copy(), [m.copy() for m in models]

    def add_up(batches):
        parts: dict[int, np.ndarray] = {}
        for pdf in batches:
            y, n = pdf["y"].to_numpy(float), pdf["n"].to_numpy(float)
            blocks = [np.ones((len(pdf), 1))]
            for i, size in enumerate(sizes):
                blocks.append(np.eye(size)[pdf[f"c{i}"].to_numpy()][:, 1:])
            x = np.hstack(blocks)
            eta = x @ coefficients.T
            loss = np.logaddexp(0.0, eta)
            mu = np.exp(eta - loss)
            for k, cols in enumerate(used):
                xk, w = x[:, cols], n * mu[:, k] * (1 - mu[:, k])
                cells = np.concatenate([
                    [y @ eta[:, k] - n @ loss[:, k]], xk.T @ (y - n * mu[:, k]),
                    ((xk.T * w) @ xk)[np.tril_indices(len(cols))]])
                parts[k] = parts.get(k, 0.0) + cells
        for k, cells in parts.items():
            yield pd.DataFrame({"model": k, "cell": np.arange(len(cells)), "value": cells})

    sums = (
        frame.patterns.mapInPandas(add_up, "model int, cell int, value double")
        .groupBy("model", "cell").agg(F.sum("value").alias("value")).toPandas())
    out = []
    for k, cols in enumerate(models):
        p = len(cols)
        cells = np.zeros(1 + p + p * (p + 1) // 2)
        mine = sums[sums["model"] == k]
        cells[mine["cell"].to_numpy(int)] = mine["value"].to_numpy()
        info = np.zeros((p, p))
        info[np.tril_indices(p)] = cells[1 + p:]
        out.append((cells[0], cells[1:1 + p], info + np.tril(info, -1).T))
    return out


def _inverse(info: np.ndarray) -> np.ndarray:
    """Inverse after scaling to a unit diagonal, so coefficients of very rare levels keep their digits."""
    scale = 1.0 / np.sqrt(np.maximum(np.diag(info), 1e-300))
    return np.linalg.pinv(info * np.outer(scale, scale), rcond=1e-13, hermitian=True) * np.outer(scale, scale)


def _independent(info: np.ndarray) -> np.ndarray:
    """Places of the columns that earlier ones do not determine, in the order of the terms, from X'WX."""
    rest, kept = info.copy(), []
    for j in range(len(info)):
        if rest[j, j] > ALIASED * info[j, j] > 0:
            kept.append(j)
            rest = rest - np.outer(rest[:, j], rest[j]) / rest[j, j]
    return np.array(kept, dtype=int)


def _climb(frame: ModelFrame, beta: np.ndarray, cols: list[np.ndarray], state: list[tuple]) -> tuple[list[tuple], list[np.ndarray]]:
    """Newton steps with step halving on the free columns of several coefficient vectors (changed in place), until each has ended:
    (sums at the end, last moves). Models that have ended take no part in later jobs. A model ends when neither its likelihood
    nor a coefficient moves, or when the likelihood stands still while coefficients drift away.
    """
    moved = [np.zeros(len(c)) for c in cols]
    open_ = [k for k, c in enumerate(cols) if len(c)]
    for _ in range(MAX_STEPS):
        if not open_:
            return state, moved
        steps = {k: _inverse(state[k][2]) @ state[k][1] for k in open_}
        tries = list(open_)
        fresh: dict[int, tuple] = {}
        while tries:
            trial = np.stack([beta[k] for k in tries])
            for row, k in zip(trial, tries):
                row[cols[k]] += steps[k]
            found = dict(zip(tries, _likelihood_sums(frame, trial, [cols[k] for k in tries])))
            fresh |= found
            tries = [k for k in tries if not found[k][0] >= state[k][0] - 1e-8 * (1 + abs(state[k][0])) and np.abs(steps[k]).max() > 1e-9]
            for k in tries:
                steps[k] = steps[k] / 2
        still = []
        for k in open_:
            gain = abs(fresh[k][0] - state[k][0])
            beta[k, cols[k]] += steps[k]
            state[k], moved[k] = fresh[k], np.abs(steps[k])
            stands = gain <= 1e-10 * (1 + abs(fresh[k][0]))
            if not stands or 1e-7 <= moved[k].max() <= DRIFT:
                still.append(k)
        open_ = still
    raise ArithmeticError(f"no convergence after {MAX_STEPS} steps")


def fit_models(frame: ModelFrame, models: Sequence[Sequence[str]]) -> list[Fit]:
    """Fit several models (lists of variables) together. Coefficients that drift away for ever are separated."""
    asked = [frame.columns(m) for m in models]
    beta = np.zeros((len(asked), 1 + len(frame.terms)))
    state = _likelihood_sums(frame, beta, asked)
    kept = [_independent(s[2]) for s in state]
    cols = [c[i] for c, i in zip(asked, kept)]
    state = [(s[0], s[1][i], s[2][np.ix_(i, i)]) for s, i in zip(state, kept)]
    state, moved = _climb(frame, beta, cols, state)
    return [
        Fit(c, beta[k], _inverse(state[k][2]), float(state[k][0]), np.setdiff1d(asked[k], c),
            frozenset(int(j) for j in c[moved[k] > DRIFT]))
        for k, c in enumerate(cols)]


def deviance_rises(frame: ModelFrame, fit: Fit, places: Sequence[tuple[int, float]]) -> list[float]:
    """By how much the deviance exceeds the fit's when coefficient j is held at a value and all others are fitted anew from 0,
    for each (j, value). An independent check of profile limits: there it is the 95 % point of chi-square."""
    if not places:
        return []
    beta = np.zeros((len(places), len(fit.beta)))
    cols = []
    for row, (j, value) in zip(beta, places):
        row[j] = value
        drifting = sorted(fit.separated)
        row[drifting] = fit.beta[drifting]
        cols.append(np.array([c for c in fit.columns if int(c) != j and int(c) not in fit.separated], dtype=int))
    state, _ = _climb(frame, beta, cols, _likelihood_sums(frame, beta, cols))
    return [2.0 * (fit.loglik - s[0]) for s in state]


def profile_limits(frame: ModelFrame, fit: Fit) -> dict[int, tuple[float, float]]:
    """95 % profile-likelihood limits of every coefficient with a finite estimate, all found in the same jobs.

    Each limit is where the log-likelihood, maximised over the other coefficients, has
    dropped by half the chi-square point. A step goes to the end of the quadratic
    approximation in that coefficient's direction. Separated coefficients stay where their
    fit left them and get nan, and so does a limit that moves off without end.
    """
    free = np.array([j for j in fit.columns if int(j) not in fit.separated], dtype=int)
    out = {int(j): [np.nan, np.nan] for j in fit.columns[1:]}
    targets = [(int(j), sign) for j in free if j > 0 for sign in (-1.0, 1.0)]
    if not targets:
        return {j: tuple(v) for j, v in out.items()}
    floor = fit.loglik - CHI2_95_1 / 2.0
    position = {int(c): i for i, c in enumerate(free)}
    inside = [int(np.where(fit.columns == c)[0][0]) for c in free]
    beta = np.tile(fit.beta, (len(targets), 1))
    state = {k: (fit.loglik, np.zeros(len(free)), _inverse(fit.covariance[np.ix_(inside, inside)])) for k in range(len(targets))}
    reach = 50.0 + 10.0 * np.sqrt(np.diag(fit.covariance))[inside]
    for _ in range(MAX_STEPS):
        for k in state:
            j, sign = targets[k]
            loglik, score, info = state[k]
            inverse = _inverse(info)
            i = position[j]
            drop = 2.0 * (loglik - floor) + score @ inverse @ score
            direction = score.copy()
            direction[i] += sign * np.sqrt(max(drop, 0.0) / inverse[i, i])
            step = inverse @ direction
            largest = np.abs(step).max()
            beta[k, free] += step * min(1.0, 3.0 / largest) if largest > 0 else step
        open_ = list(state)
        state = dict(zip(open_, _likelihood_sums(frame, beta[open_], [free] * len(open_))))
        for k in open_:
            j, sign = targets[k]
            loglik, score, info = state[k]
            others = np.delete(np.arange(len(free)), position[j])
            slack = score[others] @ _inverse(info[np.ix_(others, others)]) @ score[others] if len(others) else 0.0
            found = abs(loglik - floor) < 1e-7 * max(1.0, abs(floor) * 1e-3) and slack < 1e-8
            if found:
                out[j][int(sign > 0)] = beta[k, j]
            if found or abs(beta[k, j] - fit.beta[j]) > reach[position[j]]:
                del state[k]
        if not state:
            return {j: tuple(v) for j, v in out.items()}
    raise ArithmeticError(f"no convergence of {len(state)} limits after {MAX_STEPS} steps")


def _none(x: float):
    return None if x is None or not np.isfinite(x) else float(x)


def _estimates(frame: ModelFrame, fit: Fit):
    """(column, variable, level, beta, se, separated, aliased) of every term of the model; no number where there is none."""
    place = {int(c): i for i, c in enumerate(fit.columns)}
    for j in sorted({*map(int, fit.columns), *map(int, fit.aliased)} - {0}):
        variable, level = frame.terms[j - 1]
        usable = j in place and j not in fit.separated
        beta = fit.beta[j] if usable else np.nan
        se = float(np.sqrt(max(fit.covariance[place[j], place[j]], 0.0))) if usable else np.nan
        yield j, variable, level, beta, se, j in fit.separated, j not in place


def _coefficient_rows(frame: ModelFrame, fit: Fit, limits: Mapping[int, tuple[float, float]] | None):
    rows = []
    for j, variable, level, beta, se, separated, aliased in _estimates(frame, fit):
        low, high = (limits or {}).get(j, (np.nan, np.nan))
        p = float(normal_two_sided(np.array([beta / se]))[0]) if se > 0 else np.nan
        rows.append((variable, frame.levels[variable][0], level, _none(beta), _none(se), _none(np.exp(beta)),
                     _none(np.exp(low)), _none(np.exp(high)), _none(p), separated, aliased))
    return rows


_COEFFICIENTS = (
    "variable string, reference string, level string, beta double, se double, odds_ratio double, "
    "ci_low double, ci_high double, wald_p double, separated boolean, aliased boolean")


def multivariable_logit(df: DataFrame, outcome: str, variables: Sequence[str],
                        levels: Mapping[str, Levels] | None = None, intervals: bool = True,
                        frame: ModelFrame | None = None) -> DataFrame:
    """Adjusted odds ratios against each reference level, with profile-likelihood limits."""
    frame = frame or model_frame(df, outcome, variables, levels)
    fit = fit_models(frame, [variables])[0]
    limits = profile_limits(frame, fit) if intervals else None
    return literal_table(frame.patterns.sparkSession, _coefficient_rows(frame, fit, limits), _COEFFICIENTS)


def profile_interval(df: DataFrame, outcome: str, variables: Sequence[str],
                     levels: Mapping[str, Levels] | None = None,
                     frame: ModelFrame | None = None) -> DataFrame:
    """Estimates with Wald and profile-likelihood limits on the log odds scale.

    ``rise_low`` and ``rise_high`` certify the limits: the rise of the deviance when the coefficient is held there and the
    model is fitted anew, which is the 95 % point of chi-square (3.841459).
    """
    frame = frame or model_frame(df, outcome, variables, levels)
    fit = fit_models(frame, [variables])[0]
    limits = profile_limits(frame, fit)
    ends = [(j, end) for j, pair in limits.items() for end in pair if np.isfinite(end)]
    rise = dict(zip(ends, deviance_rises(frame, fit, ends)))
    rows = []
    for j, variable, level, beta, se, _, _ in _estimates(frame, fit):
        low, high = limits.get(j, (np.nan, np.nan))
        rows.append((variable, level, *[_none(v) for v in (
            beta, beta - Z975 * se, beta + Z975 * se, low, high, rise.get((j, low), np.nan), rise.get((j, high), np.nan))]))
    return literal_table(frame.patterns.sparkSession, rows,
                         "variable string, level string, beta double, wald_low double, wald_high double, "
                         "profile_low double, profile_high double, rise_low double, rise_high double")


def deletion_tests(frame: ModelFrame, variables: Sequence[str]) -> tuple[Fit, list[tuple[str, int, float, float]]]:
    """Full fit and (variable, df, likelihood ratio, p) of leaving each variable out. df is the difference of ranks; a variable
    that the others determine has df 0 and no p."""
    variables = list(variables)
    fits = fit_models(frame, [variables, *[[u for u in variables if u != v] for v in variables]])
    full, rows = fits[0], []
    for v, smaller in zip(variables, fits[1:]):
        df = len(full.columns) - len(smaller.columns)
        lr = max(smaller.deviance - full.deviance, 0.0)
        p = float(chi2_tail(np.array([lr]), np.array([df]))[0]) if df else np.nan
        rows.append((v, df, lr, p))
    return full, rows


def term_lrt(df: DataFrame, outcome: str, variables: Sequence[str],
             levels: Mapping[str, Levels] | None = None, frame: ModelFrame | None = None) -> DataFrame:
    """Likelihood-ratio test of deleting each variable, all on the same complete records."""
    frame = frame or model_frame(df, outcome, variables, levels)
    _, rows = deletion_tests(frame, variables)
    return literal_table(frame.patterns.sparkSession, [(v, d, lr, _none(p)) for v, d, lr, p in rows],
                         "variable string, df int, lr double, p_value double")


def backward_aic(df: DataFrame, outcome: str, variables: Sequence[str],
                 levels: Mapping[str, Levels] | None = None, frame: ModelFrame | None = None) -> DataFrame:
    """Backward selection: drop the variable whose removal lowers AIC most, until none does.

    One row per model of the path; ``removed`` is null for the starting model.
    """
    frame = frame or model_frame(df, outcome, variables, levels)
    current, path = list(variables), []
    best = fit_models(frame, [current])[0]
    path.append((0, None, ",".join(current), best.aic, best.deviance))
    while current:
        smaller = [[u for u in current if u != v] for v in current]
        fits = fit_models(frame, smaller)
        pick = min(range(len(fits)), key=lambda i: fits[i].aic)
        if fits[pick].aic >= best.aic:
            break
        path.append((len(path), current[pick], ",".join(smaller[pick]), fits[pick].aic, fits[pick].deviance))
        current, best = smaller[pick], fits[pick]
    return literal_table(frame.patterns.sparkSession, path,
                         "step int, removed string, variables string, aic double, deviance double")


def univariate_counts(df: DataFrame, outcome: str, variables: Sequence[str],
                      levels: Mapping[str, Levels] | None = None, weight: str | None = None) -> DataFrame:
    """(variable, level, a, b, c, d): events and others at the level and at the reference, with the level's rank.

    Numbers of a variable come from aggregates and ranks from ranges of the order, so a variable with very many levels is
    never one task's work.
    """
    counts = level_counts(df.where(F.col(outcome).isNotNull()), variables, outcome, weight).select(
        "variable", "level", F.col("n_resistant").alias("a"),
        (F.col("n_tested") - F.col("n_resistant")).alias("b"))
    rank = F.lit(None).cast("long")
    for v, lv in (levels or {}).items():
        rank = F.when(F.col("variable") == v, lv.rank("level")).otherwise(rank)
        counts = counts.where((F.col("variable") != v) | F.col("level").isin(list(lv.values)))
    place = F.struct(F.coalesce("__rank", F.lit(2 ** 31)).alias("rank"), "level")
    counts = counts.withColumn("__rank", rank).withColumn("__place", place)
    numbered = number_in_order(counts, ["variable"], ["__place"], "level_rank")
    return beside(
        numbered, ["variable"], n_levels=F.count(F.lit(1)), reference=F.min_by("level", "__place"), c=F.min_by("a", "__place"),
        d=F.min_by("b", "__place"), events=F.sum("a"), others=F.sum("b")).drop("__rank", "__place")


def univariate_logit(df: DataFrame, outcome: str, variables: Sequence[str],
                     levels: Mapping[str, Levels] | None = None, weight: str | None = None) -> DataFrame:
    """Crude odds ratio of each level against the reference, with its profile interval and
    the variable's p: likelihood ratio with more than two levels, else Wald.

    A one-factor model reproduces the table of counts, so every number is a closed form of
    the counts and all variables come from one pass. A zero cell gives a null estimate and
    the ``separated`` flag.
    """
    return _univariate(univariate_counts(df, outcome, variables, levels, weight))


def _univariate(cells: DataFrame) -> DataFrame:
    total = (F.col("events") + F.col("others")).cast("double")
    size = F.col("a") + F.col("b")

    def term(observed, margin):
        ratio = observed * total / (size * F.col(margin).cast("double"))
        return F.when(observed > 0, observed * F.log(ratio)).otherwise(0.0)

    cells = beside(cells, ["variable"], lr=F.sum(2.0 * (term(F.col("a"), "events") + term(F.col("b"), "others"))))
    filled = (F.least("a", "b", "c", "d") > 0)
    a, b, c, d = [F.col(x).cast("double") for x in "abcd"]
    est = cells.withColumns({
        "beta": F.when(filled, F.log(a) + F.log(d) - F.log(b) - F.log(c)),
        "se": F.when(filled, F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))}).where(F.col("level_rank") > 1)
    est = est.withColumns({
        "odds_ratio": F.exp("beta"), "z": F.col("beta") / F.col("se"),
        "df": (F.col("n_levels") - 1).cast("int"), "__ci": profile_limits_2x2("a", "b", "c", "d"),
        "separated": ~filled})
    p = F.when(F.col("n_levels") > 2, F.col("__pl")).otherwise(F.col("__pw"))
    return (
        est.withColumns({"__pl": chi2_sf("lr", "df"), "__pw": wald_p("z")})
        .select("variable", "reference", "level", "level_rank", "n_levels", "beta", "se", "odds_ratio",
                F.exp(F.nanvl("__ci.low", F.lit(None).cast("double"))).alias("ci_low"),
                F.exp(F.nanvl("__ci.high", F.lit(None).cast("double"))).alias("ci_high"),
                "lr", "df", p.alias("p_value"), "separated"))


@dataclass
class Selection:
    """Result of screening and elimination."""

    screened: list[str]
    kept: list[str]
    steps: list[tuple]
    fit: Fit
    tests: list[tuple[str, int, float, float]]


def _screen(frame: ModelFrame, outcome_counts: DataFrame, p_in: float, p_out: float,
            iterate: bool) -> Selection:
    pvalues = {r["variable"]: r["p_value"] for r in
               outcome_counts.groupBy("variable").agg(F.min("p_value").alias("p_value")).collect()}
    screened = [v for v in frame.variables if pvalues.get(v) is not None and pvalues[v] < p_in]
    steps = [(0, "screen", v, pvalues.get(v), v in screened) for v in frame.variables]
    kept, number = list(screened), 0
    fit, tests = deletion_tests(frame, kept)
    while kept:
        number += 1
        weight = {v: p if np.isfinite(p) else 1.0 for v, _, _, p in tests}  # what others determine goes first
        worst = max(tests, key=lambda t: weight[t[0]])[0]
        steps += [(number, "deletion", v, p, not (v == worst and weight[v] >= p_out)) for v, _, _, p in tests]
        if weight[worst] < p_out:
            break
        kept = [v for v in kept if v != worst]
        fit, tests = deletion_tests(frame, kept)
        if not iterate:
            break
    return Selection(screened, kept, steps, fit, tests)


def screen_and_eliminate(df: DataFrame, outcome: str, variables: Sequence[str],
                         levels: Mapping[str, Levels] | None = None, p_in: float = 0.25,
                         p_out: float = 0.05, iterate: bool = False) -> DataFrame:
    """Keep variables with a crude p below ``p_in``, fit them together, remove the one with the
    largest deletion p if it reaches ``p_out`` and refit; ``iterate`` repeats the removal.

    One row per decision: (step, stage, variable, p_value, kept).
    """
    frame = model_frame(df, outcome, variables, levels)
    crude = _crude_of(frame)
    chosen = _screen(frame, crude, p_in, p_out, iterate)
    return literal_table(
        frame.patterns.sparkSession,
        [(s, stage, v, _none(p) if p is not None else None, keep) for s, stage, v, p, keep in chosen.steps],
        "step int, stage string, variable string, p_value double, kept boolean")


def _as_levels(frame: ModelFrame) -> dict[str, Levels]:
    return {v: Levels.of(frame.levels[v]) for v in frame.variables}


def _records_of(frame: ModelFrame) -> DataFrame:
    """The patterns as weighted 0/1 records."""
    both = F.array(F.struct(F.lit(1).alias("__y"), F.col("y").alias("__w")),
                   F.struct(F.lit(0).alias("__y"), (F.col("n") - F.col("y")).alias("__w")))
    return frame.labelled.select(*frame.variables, F.inline(both)).where(F.col("__w") > 0)


def _crude_of(frame: ModelFrame) -> DataFrame:
    return univariate_logit(_records_of(frame), "__y", frame.variables, _as_levels(frame), weight="__w")


def regression_table(df: DataFrame, outcome: str, variables: Sequence[str],
                     levels: Mapping[str, Levels] | None = None, p_in: float = 0.25,
                     p_out: float = 0.05, iterate: bool = False) -> DataFrame:
    """The whole report: per level N, n, percentage with interval, crude odds ratio and p,
    adjusted odds ratio and p. Reference lines show 1; p-values stand on a variable's first
    line; adjusted columns are empty for variables not kept.
    """
    frame = model_frame(df, outcome, variables, levels)
    spark = frame.patterns.sparkSession
    crude = _crude_of(frame)
    chosen = _screen(frame, crude, p_in, p_out, iterate)
    limits = profile_limits(frame, chosen.fit) if chosen.kept else {}
    adjusted = literal_table(spark, _coefficient_rows(frame, chosen.fit, limits), _COEFFICIENTS).select(
        F.col("variable").alias("__av"), F.col("level").alias("__al"),
        format_ci("odds_ratio", "ci_low", "ci_high").alias("__adjusted"))
    tests = literal_table(spark, [(v, _none(p)) for v, _, _, p in chosen.tests], "__tv string, __tp double")
    template = literal_table(
        spark, [(i + 1, v, j + 1, lv) for i, v in enumerate(frame.variables)
                for j, lv in enumerate(frame.levels[v])],
        "variable_rank int, variable string, level_rank int, level string")
    prev = with_exact_interval(
        level_counts(_records_of(frame), frame.variables, "__y", weight="__w")).select(
        F.col("variable").alias("__pv"), F.col("level").alias("__pl"), F.col("n_tested").alias("N"),
        F.col("n_resistant").alias("n_events"), format_ci("perc", "ci_low", "ci_high").alias("perc"))
    crude_text = crude.select(
        F.col("variable").alias("__cv"), F.col("level").alias("__cl"),
        format_ci("odds_ratio", "ci_low", "ci_high").alias("__crude"))
    crude_p = crude.groupBy(F.col("variable").alias("__qv")).agg(F.min("p_value").alias("__cp"))
    first, kept = F.col("level_rank") == 1, F.col("variable").isin(chosen.kept or ["\u0000"])
    return (
        template
        .join(prev, (F.col("variable") == F.col("__pv")) & (F.col("level") == F.col("__pl")), "left")
        .join(crude_text, (F.col("variable") == F.col("__cv")) & (F.col("level") == F.col("__cl")), "left")
        .join(crude_p, F.col("variable") == F.col("__qv"), "left")
        .join(adjusted, (F.col("variable") == F.col("__av")) & (F.col("level") == F.col("__al")), "left")
        .join(tests, F.col("variable") == F.col("__tv"), "left")
        .select(
            "variable_rank", "variable", "level_rank", "level", "N", "n_events", "perc",
            F.when(first, F.lit("1")).otherwise(F.col("__crude")).alias("crude_or"),
            F.when(first, format_p("__cp")).alias("crude_p"),
            F.when(first & kept, F.lit("1")).otherwise(F.col("__adjusted")).alias("adjusted_or"),
            F.when(first, format_p("__tp")).alias("adjusted_p"))
        .orderBy("variable_rank", "level_rank"))
