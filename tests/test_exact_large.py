"""Exact tests with too many partial tables for rows: closed forms, plain sums, and what they write."""

import math
from collections import Counter

import numpy as np
import pytest

from vigilar.operators import exact
from vigilar.sources.tables import literal_table


def exact_rows(spark, tables):
    cells = literal_table(spark, [(k, e, o) for k, rows in tables.items() for e, o in rows], "k string, n1 long, n0 long")
    return {r["k"]: (r["p_value"], r["p_error"]) for r in exact.exact_p(cells, ["k"]).collect()}


def plain_fisher(rows, width):
    """p of a test whose values are rounded to a width, over all tables, in whole numbers."""
    single = sum(e + o == 1 for e, o in rows)
    m = sum(e for e, _ in rows)
    value = lambda s, k: round(math.log(math.comb(s, k)) / width)
    states = Counter({(0, 0): 1})
    levels = [(e + o, value) for e, o in rows if e + o > 1] + ([(single, lambda s, k: 0)] if single else [])
    for s, cell in levels:
        new = Counter()
        for (total, v), n in states.items():
            for k in range(min(s, m - total) + 1):
                new[total + k, v + cell(s, k)] += n * math.comb(s, k)
        states = new
    limit = sum(value(e + o, e) for e, o in rows if e + o > 1)
    return sum(n for (total, v), n in states.items() if total == m and v <= limit) / math.comb(sum(e + o for e, o in rows), m)


def written(spark):
    """Bytes of blocks, shuffles and checkpoints that Spark keeps on disk in this process."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    kept = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    summary = kept.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(kept)
    return sum(files.apply(i).length() for i in range(files.size())) + summary.getLength()


def test_spectrum_against_a_plain_sum(spark, monkeypatch):
    monkeypatch.setattr(exact, "FEW", 1)
    rng = np.random.default_rng(7)
    tables = {f"t{i}": [tuple(map(int, rng.integers(0, 9, 2))) for _ in range(rng.integers(2, 6))] for i in range(12)}
    tables = {k: [r for r in rows if sum(r)] for k, rows in tables.items()}
    tables |= {"alike": [(3, 5), (3, 5), (6, 2), (0, 8), (5, 5)], "ones": [(1, 0), (0, 1), (0, 1), (4, 2), (1, 6)], "swapped": [(40, 3), (30, 9), (25, 1)]}
    got = exact_rows(spark, tables)
    for k, rows in tables.items():
        if len(rows) > 1 and 0 < sum(e for e, _ in rows) < sum(map(sum, rows)):
            p, bound = got[k]
            assert math.isclose(p, plain_fisher(rows, exact.COARSE), rel_tol=1e-9, abs_tol=1e-12), k
            assert abs(p - plain_fisher(rows, 2.0 ** -30)) <= bound, k


@pytest.mark.parametrize("doubles", [45, 56, 80])
def test_many_small_levels_in_closed_form(spark, doubles):
    """Levels of two records: the fewer levels with one event, the less likely a table."""
    r, m = 2000, 660
    rows = [(2, 0)] * doubles + [(1, 1)] * (m - 2 * doubles) + [(0, 2)] * (r - m + doubles)
    ways = [math.comb(r, j) * math.comb(r - j, m - 2 * j) * 2 ** (m - 2 * j) for j in range(m // 2 + 1)]
    p, bound = exact_rows(spark, {"pairs": rows})["pairs"]
    assert math.isclose(p, sum(ways[doubles:]) / math.comb(2 * r, m), rel_tol=1e-9, abs_tol=1e-11)


def test_large_test_writes_no_partial_tables(spark):
    rows = [(70 + 8 * (-1) ** i, 600 + 7 * i) for i in range(12)]
    before = written(spark)
    p, bound = exact_rows(spark, {"large": rows})["large"]
    assert 0.01 < p < 0.5 and bound < 0.2
    assert written(spark) - before < 1_000_000
