"""Methods of the description's counting stages stay within what the JVM compiles (8000 bytes)."""

import pytest

from vigilar.operators import describe
from vigilar.operators.columns import apart
from vigilar.plans.session import SESSION_SETTINGS, compiled
from vigilar.sources.tables import literal_table

SF, LIMIT = "/root/testdata/sf0.001", "spark.sql.codegen.hugeMethodLimit"


def largest_method(spark, df):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(df.select("*")._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


def test_counting_stages_are_compiled(spark, monkeypatch):
    import __spark_entry__ as contract

    seen, kept = [], describe.cut_lineage
    monkeypatch.setattr(describe, "cut_lineage", lambda df: seen.append((largest_method(spark, df), spark.conf.get(LIMIT))) or kept(df))
    before = spark.conf.get(LIMIT)
    contract.queries()["describe_by_region_with_tests"](spark, SF)
    assert len(seen) == 1 and seen[0][0] <= 8000 and seen[0][1] == SESSION_SETTINGS[LIMIT]
    assert spark.conf.get(LIMIT) == before


def test_limit_goes_back_after_an_error(spark):
    before = spark.conf.get(LIMIT)
    with pytest.raises(ValueError), compiled(spark):
        assert spark.conf.get(LIMIT) == "8000"
        raise ValueError
    assert spark.conf.get(LIMIT) == before


def test_columns_apart_are_unchanged(spark):
    rows = [(True, "a", 1), (None, None, None), (False, "b", 2), (True, "a", 1)]
    df = literal_table(spark, rows, "x boolean, y string, z int")
    out = apart(df, ["x", "y", "z"])
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in df.schema]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str)
