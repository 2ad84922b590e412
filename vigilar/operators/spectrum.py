"""Exact r x 2 test of large tables by the spectrum of their values.

Under binomial events of the same odds in every level, a table has the margins' events with a known probability, and its value
is a sum over independent levels. So the share of tables up to a value is a sum over frequencies, and at each frequency the
average over shifts of a product over levels: one transform a level. Levels of one size share theirs. Frequencies are dealt out
in parts that return three numbers each; nothing that grows with the number of tables is held, sent or written.

Events beyond 10 standard deviations and 40, and values beyond bounds of the tails (Chernoff), count as lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import log_binomial_mode, log_choose
from ..sources.tables import cut_lineage

TAIL = 1e-15  # mass of values left out at either end
NOISE = 1e-13  # of a share, by floating-point sums and what is left out
PART, PARTS = 2 ** 24, 2048  # numbers transformed in a part, and parts of a test at most
TASKS = 512  # at most; a part is too few bytes for run-time re-planning to see its work
_BLOCK = 2 ** 18
_LOWER = np.array([2.0 ** -i for i in range(12, 1, -1)] + [0.35, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95])
_UPPER = 2.0 ** np.arange(-12, 9)

_TEST = ("target", "total", "width", "limit", "steps")
PLAN = "test long, part long, parts long, first long, span long"
SHARES = "test long, sure double, likely double, possible double, noise double"


def _reach(mean: float) -> float:
    """Binomial events further than this from their mean have a probability below 1e-21 a side."""
    return 10 * math.sqrt(mean + 1) + 40


def _level(size: int, single: bool, target: int, total: int, width: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Least number of events of a level, and the probabilities and values of it and the following ones."""
    mean = size / total * target
    low, high = max(0, math.floor(mean - _reach(mean))), min(size, math.ceil(mean + _reach(mean)))
    k = np.arange(low, high + 1, dtype=float)
    log_mass = np.append(0.0, np.cumsum(np.log((size - k[:-1]) / (k[1:]) * (target / (total - target)))))
    mass = np.exp(log_mass - log_mass.max())
    cell = np.zeros(len(k), np.int64) if single else np.rint(log_choose(float(size), k) / width).astype(np.int64)
    return low, mass / mass.sum(), cell


def _window(levels: list[tuple[int, bool, int]], target: int, total: int, width: float) -> tuple[int, int]:
    """First value and number of values outside which there is less than ``TAIL`` at either end."""
    variance = joint = 0.0
    for size, single, copies in levels:
        low, mass, cell = _level(size, single, target, total, width)
        k = low + np.arange(len(mass)) - size / total * target
        variance += copies * float(mass @ (k * k))
        joint += copies * float(mass @ (k * (cell - mass @ cell)))
    # on tables with the margins' events a multiple of the events may be taken off the values
    slopes = np.array([math.log((total - target) / target) / width, joint / variance])
    most, lower, upper = np.zeros(2), np.zeros((2, len(_LOWER))), np.zeros((2, len(_UPPER)))
    for size, single, copies in levels:
        low, mass, cell = _level(size, single, target, total, width)
        rest = cell - slopes[:, None] * (low + np.arange(len(mass)))
        most += copies * rest.max(axis=1)
        for sums, powers in ((lower, -_LOWER), (upper, _UPPER)):
            for i, z in enumerate(powers):
                x = z * width * rest
                top = x.max(axis=1)
                sums[:, i] += copies * (top + np.log(np.exp(x - top[:, None]) @ mass))
    outside = math.log(TAIL) + log_binomial_mode(target, total)
    shift = (slopes * target)[:, None]
    last = min(float((most + slopes * target).min()), float(((upper - outside) / (_UPPER * width) + shift).min()))
    first = float((shift - (lower - outside) / (_LOWER * width)).max())
    first, last = math.floor(first), math.ceil(last)
    return first, max(1, last - first + 1) | 1


def _period(target: int) -> int:
    """Shifts that tell the margins' events from others: a power of two or one and a half of it."""
    least = math.ceil(_reach(target)) + 1
    two = 1 << (least - 1).bit_length()
    return two * 3 // 4 if two * 3 // 4 >= least else two


def _power(x: np.ndarray, n: int) -> np.ndarray:
    out = None
    while n:
        if n & 1:
            out = x if out is None else out * x
        n >>= 1
        if n:
            x = x * x
    return out


def _spectrum(levels: list[tuple[int, bool, int]], target: int, total: int, width: float, span: int, at: np.ndarray) -> np.ndarray:
    """Mean of exp(2 pi i f value / span) over tables with the margins' events, for frequencies f."""
    period = _period(target)
    roots = np.exp(2j * math.pi / span * np.arange(span))
    scale = math.exp(-log_binomial_mode(target, total)) / period
    out = np.empty(len(at), complex)
    step = max(1, _BLOCK // period)
    for b in range(0, len(at), step):
        f, product, start = at[b:b + step], None, 0
        for size, single, copies in levels:
            low, mass, cell = _level(size, single, target, total, width)
            wave = mass * roots[f[:, None] * (cell % span) % span]
            if len(mass) > period:
                wave = np.pad(wave, ((0, 0), (0, -len(mass) % period))).reshape(len(f), -1, period).sum(axis=1)
            factor = _power(np.fft.fft(wave, period), copies)
            product = factor if product is None else product * factor
            start += copies * low
        out[b:b + step] = product @ np.exp(2j * math.pi / period * (np.arange(period) * ((target - start) % period) % period)) * scale
    return out


def _up_to(value: float, first: int, span: int, at: np.ndarray) -> np.ndarray:
    """Weights of the frequencies in the share of tables with at most this value."""
    n = int(min(max(math.floor(value) - first + 1, 0), span))
    def root(x):
        return np.exp(-2j * math.pi / span * (x % span))
    with np.errstate(divide="ignore", invalid="ignore"):
        sums = root(at * (first % span)) * (1 - root(at * n)) / (1 - root(at))
    return np.where(at == 0, n, sums) * np.where(at == 0, 1, 2) / span


def _numbers(group: pa.Table) -> tuple[int, dict[str, float], list[tuple[int, bool, int]]]:
    rows = group.to_pylist()
    return rows[0]["test"], rows[0], [(r["size"], r["single"], r["copies"]) for r in sorted(rows, key=lambda r: (r["size"], r["single"]))]


def _settled(at: dict[str, float], first: int, span: int) -> str | None:
    """Whether no table of the window counts, or every one, whatever rounding did."""
    return "none" if at["limit"] + at["steps"] < first else "all" if at["limit"] - at["steps"] >= first + span - 1 else None


def _planned(group: pa.Table) -> pa.Table:
    """The parts of a test."""
    test, at, levels = _numbers(group)
    first, span = _window(levels, at["target"], at["total"], at["width"])
    work = 1 if _settled(at, first, span) else (span // 2 + 1) * len(levels) * _period(at["target"])
    parts = min(math.ceil(work / PART), PARTS, span // 2 + 1)
    return pa.table({"test": [test] * parts, "part": range(parts), "parts": [parts] * parts, "first": [first] * parts, "span": [span] * parts})


def _shares(group: pa.Table) -> pa.Table:
    """What the frequencies of a part add to the shares of tables up to the limit, and a step's rounding below and above it."""
    test, at, levels = _numbers(group)
    if known := _settled(at, at["first"], at["span"]):
        sums = [float(known == "all")] * 3
    else:
        f = np.arange(at["part"], at["span"] // 2 + 1, at["parts"])
        mean = _spectrum(levels, at["target"], at["total"], at["width"], at["span"], f)
        sums = [float((mean * _up_to(at["limit"] + way * at["steps"], at["first"], at["span"], f)).real.sum()) for way in (-1, 0, 1)]
    noise = NOISE + 1e-15 * sum(copies for _, _, copies in levels)
    return pa.table({"test": [test], "sure": sums[:1], "likely": sums[1:2], "possible": sums[2:], "noise": [noise]})


def shares(levels: DataFrame) -> DataFrame:
    """(test, sure, likely, possible): shares of tables whose value is within the limit, whatever rounding did, as rounded, and
    by rounding at most. ``levels``: test, size, single, target, total, width, limit, steps; one row a level. Values are
    sums of log coefficients in units of ``width``; the numbers from ``target`` on are those of the test."""
    sizes = cut_lineage(levels.groupBy("test", "size", "single", *_TEST).agg(F.count(F.lit(1)).alias("copies")))
    plan = cut_lineage(sizes.groupBy("test").applyInArrow(_planned, PLAN))
    tasks = min(plan.count(), TASKS)
    parts = sizes.join(plan, "test").repartition(max(1, tasks), "test", "part").groupBy("test", "part").applyInArrow(_shares, SHARES)
    found = parts.groupBy("test").agg(F.sum("sure").alias("sure"), F.sum("likely").alias("likely"), F.sum("possible").alias("possible"), F.max("noise").alias("noise"))
    noise = F.col("noise")
    return found.select(
        "test", F.greatest(F.lit(0.0), F.col("sure") - noise).alias("sure"),
        F.when(F.col("likely") > noise, F.col("likely")).otherwise(0.0).alias("likely"), (F.greatest(F.lit(0.0), F.col("possible")) + noise).alias("possible"))
