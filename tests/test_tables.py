"""Readers and sinks in fresh folders, and plan shape."""

import os

import pytest
from pyspark.sql import functions as F

from catalogue import views as v
from vigilar.operators.association import association
from vigilar.operators.ordering import sample_per_group
from vigilar.plans.surveillance import COVARIATES, clean_isolates, analysis_table, model_cohort, status_long
from vigilar.sources.tables import (
    cut_lineage, export_decimal_comma, export_tsv, literal_table, load_breakpoints, load_table, read_decimal_comma, read_tsv, stage)

SF = "/root/testdata/sf0.001"


def test_decimal_comma(spark, tmp_path):
    path = tmp_path / "fix.csv"
    path.write_text("num_CNR;AZM_d;n\n1;12,5;3\n2;;x\n3;NA;4\n")
    got = read_decimal_comma(spark, str(path), "num_CNR string, AZM_d double, n int")
    assert [tuple(r) for r in got.collect()] == [("1", 12.5, 3), ("2", None, None), ("3", None, 4)]
    assert [t for _, t in got.dtypes] == ["string", "double", "int"]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_breakpoints(spark, tmp_path, kind):
    rows = [("AMX", "2014", "19"), ("SPT", "2014", "12"), ("XXX", "2014", "1"), ("AMX", "2015", "19,5"), ("CIP", "2014", "-")]
    path = str(tmp_path / f"cuts.{kind}")
    if kind == "csv":
        with open(path, "w") as f:
            f.write("ATB;annee;Seuil (mm)\n" + "\n".join(";".join(r) for r in rows) + "\n")
    else:
        literal_table(spark, rows, "ATB string, annee string, third string").write.parquet(path)
    got = sorted(tuple(r) for r in load_breakpoints(spark, path, ["AMX", "SPT", "CIP"], voided=["SPT"]).collect())
    assert got == [("AMX", 2014, 19.0), ("AMX", 2015, 19.5), ("CIP", 2014, None), ("SPT", 2014, None)]


def test_stage_and_load(spark, tmp_path):
    df = literal_table(spark, [(1, 2005, "a"), (2, 2006, None), (3, 2005, "c")], "id int, year_real int, x string")
    back = stage(df, str(tmp_path / "d"))
    assert back.columns == df.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert sorted(p for p in os.listdir(tmp_path / "d") if "=" in p) == ["year_real=2005", "year_real=2006"]
    stage(df, str(tmp_path / "plain"), by=None)
    assert load_table(spark, str(tmp_path / "plain"), df.schema).count() == 3
    pruned = back.where("year_real = 2005").select("id")
    assert "PartitionFilters: [isnotnull(year_real" in pruned._jdf.queryExecution().toString()


def test_a_busy_year_is_staged_in_several_files(spark, tmp_path):
    """The rebalanced write spreads a hot partition value over files and keeps quiet ones in one."""
    df = spark.range(200_000).select("id", F.when(F.col("id") % 50 == 0, 2006).otherwise(2005).alias("year_real"), F.sha2(F.col("id").cast("string"), 256).alias("x")) \
        .repartition(12, "id")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "1m")
    try:
        back = stage(df, str(tmp_path / "hot"))
    finally:
        spark.conf.unset(size)
    files = {y: len([f for f in os.listdir(tmp_path / "hot" / f"year_real={y}") if f.endswith(".parquet")]) for y in (2005, 2006)}
    assert files[2005] >= 5 and files[2006] <= 2
    assert back.count() == 200_000 and back.agg(F.sum("id")).first()[0] == 199_999 * 100_000


def test_exports_are_read_back(spark, tmp_path):
    rows = [(1, 0.1, "a\tb", None), (2, None, 'say "x"', "p;q"), (3, 1e-12, "line\nbreak", "0,5"), (4, 1e300, "back\\", "NAN")]
    df = literal_table(spark, rows, "k int, x double, t string, u string")
    export_tsv(df, str(tmp_path / "tsv"))
    assert sorted(map(tuple, read_tsv(spark, str(tmp_path / "tsv"), df.schema, line_breaks=True).collect())) == rows
    flat = df.where("k <> 3")
    export_decimal_comma(flat, str(tmp_path / "comma"))
    assert sorted(map(tuple, read_decimal_comma(spark, str(tmp_path / "comma"), df.schema).collect())) == [r for r in rows if r[0] != 3]
    assert any("1;0,1;" in p.read_text() for p in (tmp_path / "comma").glob("*.csv"))


def test_tsv(spark, tmp_path):
    df = literal_table(spark, [("a", 1, None), ("b", None, "x")], "k string, n int, t string").coalesce(1)
    export_tsv(df, str(tmp_path / "out"))
    part = [p for p in os.listdir(tmp_path / "out") if p.endswith(".csv")][0]
    assert (tmp_path / "out" / part).read_text() == "k\tn\tt\na\t1\t\nb\t\tx\n"


def test_checkpoint_uses_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    out = cut_lineage(spark.range(10).groupBy((F.col("id") % 2).alias("g")).count())
    assert out.count() == 2
    assert spark.sparkContext.getCheckpointDir().replace("file:", "").startswith(folder.replace("file:", ""))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_reads_only_what_it_needs(spark):
    ages = v.isolates(spark, SF, drugs=False).select("row_id", "age")
    text = plan(ages)
    assert "lineitem" not in text and "o_totalprice" not in text and "c_acctbal" not in text


def test_statuses_need_one_exchange_of_the_lines(spark):
    lines = v.drug_lines(spark, SF)
    text = plan(lines)
    assert text.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in text


def test_no_python_and_no_cartesian_in_the_counting_path(spark):
    rows = v.isolates(spark, SF).where("metrop")
    out = association(rows, ["age_cut", "sexe"], {"CIP": "CIP_SIR"}).drop("p_value")
    text = plan(out)
    assert "Cartesian" not in text and "NestedLoop" not in text and "ArrowEvalPython" not in text


def test_sampling_limits_groups_before_the_exchange(spark):
    text = plan(sample_per_group(spark.range(100).withColumn("g", F.col("id") % 3), ["g"], 4, "id"))
    assert text.count("WindowGroupLimit") == 2


def test_long_table_and_cohorts(spark):
    long = status_long(analysis_table(
        clean_isolates(v.raw_isolates(spark, SF), v.breakpoints(spark), settings=v.SETTINGS), v.travel(spark), v.SETTINGS),
        "row_id")
    assert set(long.columns) == {"row_id", *COVARIATES, "ATB", "status"}
    assert long.where("status is null or status not in (0, 1)").count() == 0
    everyone, complete = model_cohort(long, "C3G")
    assert 0 < complete.count() <= everyone.count()


def test_corrections_reach_the_calls(spark):
    raw = v.raw_isolates(spark, SF)
    fixes = raw.where("year = 1996").select("num_CNR", F.lit(6.0).alias("AZM_d"))
    out = clean_isolates(raw, v.breakpoints(spark), fixes, v.SETTINGS).where("year = 1996")
    assert [r["AZM_SIR"] for r in out.select("AZM_SIR").distinct().collect()] == ["R"]


def test_invariants_after_cleaning(spark):
    table = v.isolates(spark, SF)
    zeros = table.agg(*[F.count_if(F.col(f"{d}_d") == 0).alias(d) for d in v.DRUGS.values()]).first()
    assert not any(zeros)
    assert table.where("year_real < 1995").count() == 0 and table.where("age < 0").count() == 0


@pytest.mark.parametrize("name", ["describe_by_with_tests", "age_sex_table_with_tests"])
def test_table_and_tests_share_one_pass(spark, name):
    import __spark_entry__ as contract
    df = contract.queries()[name](spark, SF)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert sum("FileScan" in line and "l_orderkey" in line for line in final.splitlines()) == 1
    assert "ReusedExchange" in final
