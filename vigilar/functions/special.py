"""Tail probabilities and exact limits, applied to aggregated rows only.

The numpy parts run inside Arrow-batched pandas UDFs: one value per group of
counts, never one per record.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nulls import col

Z975 = 1.959963984540054  # 97.5 % point of the standard normal
CHI2_95_1 = Z975**2  # 95 % point of chi-square with 1 df
_LIMITS = T.StructType(
    [T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]
)


def _each(fn, x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([fn(v) for v in x.ravel()], float).reshape(x.shape)


def _erfc(x) -> np.ndarray:
    return _each(math.erfc, x)


def log_gamma(x) -> np.ndarray:
    return _each(math.lgamma, x)


def _stirling_rest(n: np.ndarray) -> np.ndarray:
    """log n! minus Stirling's formula, n >= 0: its series at n + 16, taken back by a product of sixteen factors."""
    def main(x):
        return (x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi)

    small = n < 16
    x = np.where(small, n + 16.0, n)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / x ** 2) / x ** 2) / x ** 2) / x
    if not small.any():
        return series
    low = n[small]
    product = np.ones(low.shape)
    for j in range(1, 17):
        product *= low + j
    out = series.copy()
    out[small] = main(low + 16.0) + series[small] - np.log(product) - main(np.maximum(low, 1e-300))
    return out


def log_choose(n, k) -> np.ndarray:
    """log of n over k for real arguments, without the cancellation of large log factorials; 0 outside 0 < k < n."""
    n, k = np.broadcast_arrays(np.asarray(n, float), np.asarray(k, float))
    out = np.zeros(n.shape)
    inner = (k > 0) & (k < n)
    a, m = k[inner], n[inner]
    b = m - a
    entropy = -a * np.log(a / m) - b * np.log1p(-a / m)
    out[inner] = entropy + 0.5 * np.log(m / (2 * math.pi * a * b)) + _stirling_rest(m) - _stirling_rest(a) - _stirling_rest(b)
    return out


def log_binomial_mode(k: float, n: float) -> float:
    """log probability of k of n events with the odds k to n - k, 0 < k < n."""
    rest_n, rest_k, rest = _stirling_rest(np.array([n, k, n - k], float))
    return float(0.5 * math.log(n / (2 * math.pi * k * (n - k))) + rest_n - rest_k - rest)


def chi2_tail(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(X > x) for integer df, by the positive-term recurrence of Q(df/2, x/2)."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(x) & np.isfinite(df) & (df >= 1)
    h, d = np.maximum(x[ok], 0.0) / 2.0, df[ok].astype(int)
    odd = d % 2 == 1
    q = np.where(odd, _erfc(np.sqrt(h)) if h.size else h, np.exp(-h))
    a = np.where(odd, 0.5, 1.0)
    with np.errstate(divide="ignore"):
        log_h = np.log(h)
    while True:
        todo = a < d / 2.0 - 1e-9
        if not todo.any():
            break
        with np.errstate(invalid="ignore"):
            term = np.exp(a * log_h - h - log_gamma(a + 1.0))
        q = np.where(todo, q + np.where(h > 0, term, 0.0), q)
        a = np.where(todo, a + 1.0, a)
    out[ok] = np.minimum(q, 1.0)
    return out


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    z = np.abs(np.asarray(z, float))
    return np.where(np.isnan(z), np.nan, _erfc(np.nan_to_num(z) / math.sqrt(2.0)))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)
_NODES, _WEIGHTS = (_NODES + 1) / 2, _WEIGHTS / 2  # on (0, 1)
_DEPTH = 45.0  # an integral goes as far as the log density falls by this much


def _log_density(a, b, u):
    """Log density of the logit of a beta variable at distance ``u`` from its mode, relative to the mode."""
    q, u = np.minimum(a, b) / (a + b), np.where(a <= b, u, -u)  # seen from the rarer side, so that small parts keep their digits
    return (a + b) * (q * u - np.log1p(q * np.expm1(np.minimum(u, 600.0))))


def _density_slope(a, b, u):
    q, e = a / (a + b), np.exp(-np.abs(u))
    return a - (a + b) * np.where(u > 0, q / (q + (1 - q) * e), q * e / (1 - q + q * e))


def _tail_integral(a, b, u, sign: float):
    """(integral over the density relative to the density at ``u``, log density at ``u``) from ``u`` outwards.

    The log density is concave, so the integrand falls smoothly to nothing within a reach that Newton steps find.
    """
    base = _log_density(a, b, u)
    reach = np.sqrt(2 * _DEPTH * (1 / a + 1 / b))
    for _ in range(100):
        over = _log_density(a, b, u + sign * reach) - base + _DEPTH
        fresh = reach - over / (sign * _density_slope(a, b, u + sign * reach))
        fresh = np.where(fresh > 0, fresh, reach / 2)
        close = np.abs(fresh - reach) <= 1e-3 * reach
        reach = fresh
        if close.all():
            break
    t = u[:, None] + sign * reach[:, None] * _NODES
    return reach * (np.exp(_log_density(a[:, None], b[:, None], t) - base[:, None]) @ _WEIGHTS), base


def beta_limit(tail: float, a, b, sign: float):
    """Point of a beta variable (a, b >= 1) below (sign -1) or above (sign 1) which there is the probability ``tail``.

    One method for all sizes: the density of the logit is integrated by Gauss-Legendre nodes between the point and where it
    has died away, and Newton steps on the log of that tail find the point. Distances count from the mode, so neither tiny
    nor large parameters cancel. ``tail`` is small enough for the point to lie on its side of the mode (up to 0.3).
    """
    a, b = (np.array(x, float).ravel() for x in np.broadcast_arrays(a, b))
    zero = np.zeros(a.shape)
    goal = np.log(tail * (_tail_integral(a, b, zero, -1.0)[0] + _tail_integral(a, b, zero, 1.0)[0]))
    u, before = sign * 2.0 * np.sqrt(1 / a + 1 / b), np.full(a.shape, np.inf)
    for _ in range(100):
        size, base = _tail_integral(a, b, u, sign)
        step = sign * size * (np.log(size) + base - goal)
        u, far = u + step, np.abs(step / u)
        if np.all((far <= 1e-13) | ((far < 1e-7) & (far > before / 2))):  # or what is left is rounding
            break
        before = far
    else:
        raise ArithmeticError("no convergence of a beta limit")
    odds = a / b * np.exp(u)
    return odds / (1 + odds)


def exact_binomial_limits(x: np.ndarray, n: np.ndarray):
    """95 % exact (Clopper-Pearson) limits; n = 0 or unknown counts give nan."""
    x, n = np.asarray(x, float), np.asarray(n, float)
    low, high = np.full(x.shape, np.nan), np.full(x.shape, np.nan)
    ok = np.isfinite(x) & np.isfinite(n) & (n > 0)
    low[ok & (x == 0)] = 0.0
    high[ok & (x == n)] = 1.0
    some = ok & (x > 0)
    if some.any():
        low[some] = beta_limit(0.025, x[some], n[some] - x[some] + 1, -1.0)
    some = ok & (x < n)
    if some.any():
        high[some] = beta_limit(0.025, x[some] + 1, n[some] - x[some], 1.0)
    return low, high


def _root(f, inside: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """Vectorised bisection: f <= 0 at ``inside``, f > 0 at ``outside``."""
    for _ in range(100):
        mid = 0.5 * (inside + outside)
        over = f(mid) > 0
        inside, outside = np.where(over, inside, mid), np.where(over, mid, outside)
    return 0.5 * (inside + outside)


def odds_ratio_profile(a, b, c, d):
    """95 % profile-likelihood limits of the log odds ratio of a 2x2 table of counts
    (a events and b others at the level, c and d at the reference).

    For a fixed log odds ratio the fitted event count at the level solves a quadratic,
    so each deviance is closed form. Zero cells give nan limits.
    """
    a, b, c, d = [np.asarray(v, float) for v in (a, b, c, d)]
    low, high = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
    ok = np.minimum(np.minimum(a, b), np.minimum(c, d)) > 0
    a, b, c, d = a[ok], b[ok], c[ok], d[ok]
    if not a.size:
        return low, high
    n1, n0, m = a + b, c + d, a + c
    best = np.log(a * d / (b * c))
    se = np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)

    def deviance_excess(theta):
        r = np.exp(theta)
        # (1 - r) u^2 + (n0 - m + r (n1 + m)) u - r n1 m = 0
        qa, qb, qc = 1 - r, n0 - m + r * (n1 + m), -r * n1 * m
        u = -2 * qc / (qb + np.sqrt(np.maximum(qb * qb - 4 * qa * qc, 0.0)))
        fit = [u, n1 - u, m - u, n0 - m + u]
        total = sum(o * np.log(o / np.maximum(e, 1e-300)) for o, e in zip((a, b, c, d), fit))
        return 2 * total - CHI2_95_1

    for sign, out in ((-1.0, low), (1.0, high)):
        far = best + sign * 2.0 * se
        for _ in range(60):
            short = deviance_excess(far) <= 0
            if not short.any():
                break
            far = np.where(short, far + sign * se, far)
        out[ok] = _root(deviance_excess, best, far)
    return low, high


@F.pandas_udf(T.DoubleType())
def _chi2_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_tail(x.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def _z_udf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z.to_numpy(float)))


@F.pandas_udf(_LIMITS)
def _binomial_udf(x: pd.Series, n: pd.Series) -> pd.DataFrame:
    low, high = exact_binomial_limits(x.to_numpy(float), n.to_numpy(float))
    return pd.DataFrame({"low": low, "high": high})


@F.pandas_udf(_LIMITS)
def _or_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    low, high = odds_ratio_profile(*[s.to_numpy(float) for s in (a, b, c, d)])
    return pd.DataFrame({"low": low, "high": high})


def _known(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def chi2_sf(x: Column | str, df: Column | str) -> Column:
    return _known(_chi2_udf(col(x).cast("double"), col(df).cast("double")))


def wald_p(z: Column | str) -> Column:
    return _known(_z_udf(col(z).cast("double")))


def exact_limits(x: Column | str, n: Column | str) -> Column:
    """Struct (low, high) of the exact 95 % interval of x / n."""
    return _binomial_udf(col(x).cast("double"), col(n).cast("double"))


def profile_limits_2x2(a, b, c, d) -> Column:
    """Struct (low, high) on the log odds ratio scale."""
    return _or_udf(*[col(v).cast("double") for v in (a, b, c, d)])
