"""Plan shapes that have to hold at any size."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from vigilar.operators import aggregate, joins, ordering, windows

SF = "/root/testdata/sf0.001"
QUERIES = contract.queries()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "freq_table", "proportions", "specimen_groups", "mic_distribution", "chi_square", "association", "fisher_exact", "describe", "describe_by",
    "profile_of_resistant", "value_census", "group_size", "univariate_logit"])
def test_totals_need_no_window(spark, name):
    assert "Window" not in physical(QUERIES[name](spark, SF))


def test_census_of_wide_measures_exchanges_levels_once(spark):
    df = spark.range(1000).select(*[(F.col("id") * k % 97).alias(f"d{k}") for k in range(1, 12)])
    plan = physical(aggregate.long_counts(df, df.columns))
    assert plan.count("Exchange hashpartitioning(variable") == 1 and plan.count("Exchange") == 1
    assert "partial_sum" in plan
    assert aggregate.long_counts(df, df.columns).agg(F.sum("n")).first()[0] == 11_000


def test_numbers_in_order_spread_a_group_over_ranges(spark):
    rows = [("a" if i % 10 else None, i * 7919 % 5000, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(6)
    out = ordering.number_in_order(df, ["g"], ["x"], "nr")
    want = {}
    for g in ("a", None):
        want |= {r[2]: k for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), 1)}
    assert {r["id"]: r["nr"] for r in out.collect()} == want
    assert "Window" not in physical(out)


def test_hot_keys_are_split_by_their_count(spark):
    rows = [(i, "hot" if i % 4 else None if i % 8 else f"k{i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, k string")
    out = windows.group_size(df, ["k"], "id", "n", hot_rows=100)
    assert "broadcast" not in out._jdf.queryExecution().logical().toString().lower()
    assert {r["n"] for r in out.filter("k = 'hot'").select("n").distinct().collect()} == {3000}
    assert out.filter("k IS NULL").filter("n IS NOT NULL").count() == 0 and out.count() == 4000


def test_lookups_are_checked_for_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        joins.one_row_per_key(df, ["k"]).collect()
