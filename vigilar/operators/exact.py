"""Exact r x 2 test by a dynamic programme whose partial tables are rows, or by the spectrum of the values.

Tests with few partial tables go through the programme, others through the spectrum, where values have a coarser width. A step adds one level to every test at once. Partial tables are rows (test, events so far, value, mass): the value is the
sum of the levels' log binomial coefficients, each rounded to a width; the mass is the probability of the partial table. Tasks
extend their rows and add up equal ones before the exchange, so a test is the work of all tasks and a step one exchange.
A partial table is settled as soon as all its completions count or none does, and left when what could count is negligible.

The observed table is rounded like all others, so equally likely tables stay so. What counts for sure and what may count,
whatever the rounding did, bound p; the distance to the bounds is returned next to it. ``spectrum.py`` has the same three sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import log_choose
from ..sources.tables import cut_lineage
from . import spectrum

FINE, COARSE = 2.0 ** -30, 2.0 ** -8  # widths of a value, for tests with few partial tables and for others
FEW = 200_000  # partial tables at most, counted without merging, for the fine width
TIE = 1e-7  # tables count as equally likely within this relative difference
NEGLIGIBLE = 1e-13  # mass from which on a partial table is followed
STEPS_AT_ONCE = 6  # steps between two checkpoints
TASKS = 8  # of a step; partial tables are too few bytes for run-time re-planning to see their work
TILTS = np.arange(-6, 7) * 0.25  # slopes at which the best completion is bounded, around the overall odds
_BLOCK = 500_000

STATES = "test long, events long, value long, mass double"
SURE, LIKELY, POSSIBLE = 0, 1, 2  # values of settled rows, whose events are -1


@F.pandas_udf(T.DoubleType())
def _log_choose(n: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(log_choose(n.to_numpy(float), k.to_numpy(float)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _best_tilted(size: pd.Series, single: pd.Series, odds: pd.Series) -> pd.Series:
    """Greatest log coefficient minus slope times events of a level, for every slope: a bound by duality."""
    n, alone = size.to_numpy(float)[:, None], single.to_numpy(bool)[:, None]
    slope = np.log(odds.to_numpy(float))[:, None] + TILTS
    mode = np.minimum(np.floor((n + 1) / (1 + np.exp(slope))), n)
    best = np.where(alone, np.maximum(0.0, -slope * n), log_choose(np.broadcast_to(n, mode.shape), mode) - slope * mode)
    return pd.Series(list(best))


def _levels(cells: DataFrame) -> DataFrame:
    """One row per test and level, with the test's width and limit. Levels of one record are one row, since they only differ in
    how many of them have an event."""
    alone = F.col("size") == 1
    rows = cells.filter(~alone).select("test", "size", "target", "total", F.lit(False).alias("single"), _log_choose("size", "n1").alias("seen")).union(
        cells.filter(alone).groupBy("test").agg(F.sum("size"), F.max("target"), F.max("total"), F.lit(True), F.lit(0.0)))
    rows = rows.withColumn("ways", F.log(F.least("size", "target") + F.lit(1.0)))
    sums = {f"__{name}": F.sum(F.rint(F.col("seen") / F.lit(width))) + F.lit(TIE) / F.lit(width) for name, width in (("fine", FINE), ("coarse", COARSE))}
    few = F.col("__some") <= math.log(FEW)
    tests = rows.groupBy("test").agg(F.count(F.lit(1)).alias("steps"), (F.sum("ways") - F.max("ways")).alias("__some"), *[v.alias(k) for k, v in sums.items()]).select(
        "test", "steps", F.when(few, FINE).otherwise(COARSE).alias("width"), F.when(few, F.col("__fine")).otherwise(F.col("__coarse")).alias("limit"))
    return rows.join(tests, "test")


def _steps(levels: DataFrame) -> DataFrame:
    """One row per test and level, levels from the smallest: what a step has to know."""
    order = Window.partitionBy("test").orderBy("size", "single", "seen")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    rows = levels.withColumn("tilted", _best_tilted("size", "single", (F.col("total") - F.col("target")) / F.col("target")))
    sums = {f"tilt{i}": F.coalesce(F.sum(F.col("tilted")[i]).over(after), F.lit(0.0)) for i in range(len(TILTS))}
    return rows.select(
        "test", F.row_number().over(order).alias("step"), "steps", "size", "single", "target",
        F.coalesce(F.sum("size").over(after), F.lit(0)).alias("room"), "width", "limit",
        F.log((F.col("total") - F.col("target")) / F.col("target")).alias("slope"),
        F.coalesce(F.sum("ways").over(after), F.lit(0.0)).alias("options"), *[c.alias(n) for n, c in sums.items()])


def _rows(test: np.ndarray, events: np.ndarray, value: np.ndarray, mass: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (test, events, value, mass)], ["test", "events", "value", "mass"])


def _merged(test: int, events: np.ndarray, value: np.ndarray, mass: np.ndarray) -> pa.RecordBatch:
    """Partial tables of one test with the same events and value become one."""
    if not len(events):
        return _rows(np.zeros(0, np.int64), events, value, mass)
    v0 = int(value.min())
    span = int(value.max()) - v0 + 1
    key = (events - events.min()) * span + (value - v0)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    one = order[first]
    return _rows(np.full(len(first), test), events[one], value[one], np.add.reduceat(mass[order], first))


_NUMBERS = ("step", "steps", "size", "single", "target", "room", "limit", "width", "slope", "options", "last_single",
            *[f"tilt{i}" for i in range(len(TILTS))])


def _extended(test: int, at: dict[str, float], events: np.ndarray, value: np.ndarray, mass: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All ways to go on from some partial tables of one test, whose numbers of this step are ``at``. The numbers that follow
    from the events of the level or of the rest alone are tables."""
    size, room, left = int(at["size"]), int(at["room"]), int(at["target"]) - events
    rows_left, width = int(at["steps"] - at["step"]), at["width"]
    # beyond 7 standard deviations and 12 events around the mean there is next to no mass; it counts as lost
    mean = left * (size / (size + room))
    reach = 7 * np.sqrt(mean + 1) + 12
    low = np.maximum(np.maximum(0, left - room), np.floor(mean - reach).astype(np.int64))
    high = np.minimum(np.minimum(size, left), np.ceil(mean + reach).astype(np.int64))
    count = np.maximum(high - low + 1, 0)
    k0, rest0 = int(low.min()), int((left - high).min())
    ways = log_choose(float(size), np.arange(k0, int(high.max()) + 1))
    rest = np.arange(rest0, int((left - low).max()) + 1, dtype=float)
    open_ways = log_choose(float(room), rest)
    cells = np.zeros(len(ways), np.int64) if at["single"] else np.rint(ways / width).astype(np.int64)
    slopes = at["slope"] + TILTS
    most = np.minimum(open_ways, (np.array([at[f"tilt{i}"] for i in range(len(TILTS))]) + rest[:, None] * slopes).min(axis=1)) / width
    # completions, each as likely as its value says: at most so many of them
    completions = np.minimum(log_choose(rest + rows_left - 1, np.full(len(rest), rows_left - 1.0)), at["options"])
    ending = None
    if rows_left == 1:
        ending = np.zeros(len(rest), np.int64) if at["last_single"] else np.rint(open_ways / width).astype(np.int64)
    base = np.log(mass) - log_choose(float(size + room), left.astype(float))
    limit, slack = at["limit"], at["steps"]
    for block in np.split(np.arange(len(events)), np.flatnonzero(np.diff(np.cumsum(count) // _BLOCK)) + 1):
        n = count[block]
        of = np.repeat(block, n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[block], n)
        r = left[of] - k - rest0
        new = np.exp(base[of] + ways[k - k0] + open_ways[r])
        cell = value[of] + cells[k - k0]
        lost = max(0.0, float(mass[block].sum() - new.sum()))
        if ending is not None:
            final = cell + ending[r]
            settled = [new[final + slack <= limit].sum(), new[final <= limit].sum(), new[final - slack <= limit].sum() + lost]
            out = (k[:0], cell[:0], new[:0])
        else:
            counts = cell + most[r] + rows_left / 2 + slack <= limit
            never = cell - slack > limit
            # by Markov's inequality for exp(-value), this is the most of a state's mass that can count
            chance = np.minimum(0.0, completions[r] - open_ways[r] + (limit + slack + rows_left / 2 - cell) * width)
            follow = ~counts & ~never
            small = follow & (np.log(np.maximum(new, 1e-300)) + chance < math.log(NEGLIGIBLE))
            sure = new[counts].sum()
            settled = [sure, sure, sure + (new[small] * np.exp(chance[small])).sum() + lost]
            follow &= ~small
            out = (events[of[follow]] + k[follow], cell[follow], new[follow])
        yield _merged(test, *out)
        yield _rows(np.full(3, test), np.full(3, -1), np.array([SURE, LIKELY, POSSIBLE]), np.array(settled, float))


def _step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        test, events, value, mass = (batch.column(i).to_numpy() for i in range(4))
        over = (events < 0) | batch.column(4).is_null().to_numpy(zero_copy_only=False)
        yield _rows(test[over], events[over], value[over], mass[over])
        rows = np.flatnonzero(~over)
        rows = rows[np.argsort(test[rows], kind="stable")]
        for part in np.split(rows, np.flatnonzero(np.diff(test[rows])) + 1):
            if len(part):
                at = {c: float(batch.column(4 + i)[int(part[0])].as_py()) for i, c in enumerate(_NUMBERS)}
                yield from _extended(int(test[part[0]]), at, events[part], value[part], mass[part])


def exact_p(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, p_value, p_error) of the tables whose cells (keys, n1, n0) are given, one row a level.

    p is the total probability of all tables with the same margins that are no more likely than the observed one. The exact
    p lies within ``p_error`` of it (rounded up; of the order of 1e-9 for tables with few partial tables). Tables with an
    empty margin or one level have no row. All tests share the steps; a test with fewer levels is over earlier.
    """
    known = cells.where(F.col("n1") + F.col("n0") > 0)
    tests = known.groupBy(*keys).agg(F.sum("n1").alias("__c1"), F.sum("n0").alias("__c0"), F.count(F.lit(1)).alias("__n"))
    tests = cut_lineage(tests.where((F.col("__c1") > 0) & (F.col("__c0") > 0) & (F.col("__n") > 1)).withColumn("test", F.monotonically_increasing_id()))
    named = known
    for k in keys:
        named = named.withColumnRenamed(k, f"__k_{k}")
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    joined = named.join(tests, same)
    levels = cut_lineage(_levels(joined.select(
        "test", "n1", (F.col("n1") + F.col("n0")).alias("size"), F.least("__c1", "__c0").alias("target"), (F.col("__c1") + F.col("__c0")).alias("total"))))
    fine = F.col("width") == FINE
    n_few, n_many = levels.agg(F.count_if(fine), F.count_if(~fine)).first()
    found = [_stepwise(levels.where(fine))] if n_few or not n_many else []
    found += [spectrum.shares(levels.where(~fine))] if n_many else []
    p = F.least(F.lit(1.0), F.col("likely"))
    return tests.join(reduce(DataFrame.union, found), "test").select(
        *keys, p.alias("p_value"), (F.greatest(F.least(F.lit(1.0), F.col("possible")) - p, p - F.col("sure")) + F.lit(1e-12)).alias("p_error"))


def _stepwise(levels: DataFrame) -> DataFrame:
    """(test, sure, likely, possible) by steps over the levels."""
    steps = cut_lineage(_steps(levels))
    last = steps.filter(F.col("step") == F.col("steps")).select("test", F.col("single").alias("last_single"))
    steps = steps.join(last, "test")
    # a single pooled level of one-record levels: every table is as likely as any other
    states = steps.filter((F.col("step") == 1) & (F.col("steps") > 1)).select("test", F.lit(0).cast("long").alias("events"), F.lit(0).cast("long").alias("value"), F.lit(1.0).alias("mass"))
    whole = steps.filter(F.col("steps") == 1).select("test", F.lit(-1).cast("long").alias("events"), F.explode(F.array(*[F.lit(c).cast("long") for c in (SURE, LIKELY, POSSIBLE)])).alias("value"),
                                                     F.lit(1.0).alias("mass"))
    states = states.union(whole)
    n_tests, n_steps = steps.agg(F.count_if(F.col("step") == 1), F.max("steps")).first()
    for k in range(1, n_steps or 1):
        wanted = steps.filter((F.col("step") == k) & (F.col("step") < F.col("steps")))
        if n_tests <= 10_000:  # one short row a test
            wanted = F.broadcast(wanted)
        states = states.join(wanted, "test", "left").select(*[c.split()[0] for c in STATES.split(", ")], *_NUMBERS) \
            .mapInArrow(_step, STATES).repartition(TASKS, "test", "events", "value").groupBy("test", "events", "value").agg(F.sum("mass").alias("mass"))
        if k % STEPS_AT_ONCE == 0 and k < n_steps - 1:
            states = cut_lineage(states)
    total = {c: F.coalesce(F.sum(F.when(F.col("value") == v, F.col("mass"))), F.lit(0.0)) for c, v in (("sure", SURE), ("likely", LIKELY), ("possible", POSSIBLE))}
    return states.filter("events < 0").groupBy("test").agg(*[v.alias(c) for c, v in total.items()])
