"""Planted cases: null rules, cleaning, interpretation, tables, joins."""

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vigilar.functions import formats as fm
from vigilar.functions import nulls as nl
from vigilar.functions import text as tx
from vigilar.functions.levels import Levels, with_levels
from vigilar.operators import aggregate as agg
from vigilar.operators import columns as cols
from vigilar.operators import derive, interpret, joins, mic, ordering, prevalence, quality, reshape, windows
from vigilar.operators.describe import VariableSpec, describe, describe_by
from vigilar.plans import fixed_values as fv
from vigilar.sources.tables import literal_table


def rows(df, *cols_):
    return [tuple(r) for r in (df.select(*cols_) if cols_ else df).collect()]


def one(spark, column, schema="a int, b int, c int", row=(1, None, 0)):
    return literal_table(spark, [row], schema).select(column.alias("x")).first()["x"]


def test_condition_null_propagates(spark):
    cond = F.col("b") > 0
    assert one(spark, nl.if_else(cond, F.lit("y"), F.lit("n"))) is None
    assert one(spark, cols.case_when((cond, "y"), default="n")) == "n"


def test_membership_is_never_null(spark):
    assert one(spark, nl.in_set("b", [1])) is False
    assert one(spark, nl.in_set("a", [])) is False
    assert one(spark, nl.same("b", 1)) is False


def test_regex_null_and_no_match(spark):
    schema, row = "t string, u string", ("abc", None)
    assert one(spark, nl.matches("u", "a"), schema, row) is False
    assert one(spark, nl.detects("u", "a"), schema, row) is None
    assert one(spark, nl.extract("t", "x|z"), schema, row) is None
    assert one(spark, nl.extract("t", "c|b"), schema, row) == "b"
    assert one(spark, tx.replace_first("t", "[ab]", "_"), schema, row) == "_bc"
    assert one(spark, tx.paste("t", "u"), schema, row) == "abcNA"


@pytest.mark.parametrize("values,expected", [((0, None, None), 0), ((None, 1, 0), 1), ((None, None, None), None)])
def test_class_status(spark, values, expected):
    df = literal_table(spark, [values], "a int, b int, c int")
    assert rows(derive.class_resistance(df, ["a", "b", "c"], "k"), "k") == [(expected,)]


def test_sums_and_ratios(spark):
    assert one(spark, nl.row_sum(["a", "b", "c"])) == 1
    assert one(spark, nl.ratio("a", "c")) is None
    df = literal_table(spark, [(None,), (None,)], "x int")
    assert df.agg(nl.sum_or_zero("x")).first()[0] == 0
    assert df.agg(F.min("x")).first()[0] is None


def test_numbers_with_decimal_comma(spark):
    df = literal_table(spark, [("1,5",), ("x",), (" 2 ",), (None,)], "t string")
    assert rows(df.select(nl.number("t"))) == [(1.5,), (None,), (2.0,), (None,)]


def test_rounding_half_to_even(spark):
    df = literal_table(spark, [(1, 16), (1, 8), (2, 3), (1, 1), (0, 0), (3, 16)], "n int, t int")
    assert [r[0] for r in rows(df.select(fm.percent("n", "t", 1)))] == [6.2, 12.5, 66.7, 100.0, None, 18.8]
    assert [r[0] for r in rows(df.select(fm.format_n_pct("n", "t")))] == [
        "1 (6.2)", "1 (12.5)", "2 (66.7)", "1 (100)", "0", "3 (18.8)"]


def test_p_and_interval_text(spark):
    df = literal_table(spark, [(0.0004,), (0.0008,), (0.001,), (0.0456,), (0.5,), (None,)], "p double")
    assert [r[0] for r in rows(df.select(fm.format_p("p")))] == ["<0.001", "0.001", "0.001", "0.046", "0.5", None]
    assert [r[0] for r in rows(df.select(fm.format_p("p", 0.001)))] == ["<0.001", "<0.001", "<0.001", "0.046", "0.5", None]
    ci = literal_table(spark, [(1.5, 0.456, None)], "v double, l double, h double")
    assert rows(ci.select(fm.format_ci("v", "l", "h"))) == [("1.5 (0.46 - NA)",)]


def test_levels(spark):
    lv = Levels.of(("a", "b", "c"), reference="b")
    assert lv.ordered == ("b", "a", "c")
    df = literal_table(spark, [("a",), ("b",), ("z",), (None,)], "x string")
    assert rows(with_levels(df, "x", lv, "r")) == [("a", 2), ("b", 1), (None, None), (None, None)]
    with pytest.raises(ValueError):
        Levels.of(("a", "a"))


def test_column_choice(spark):
    df = literal_table(spark, [(1, 2, 3)], "AZM_d int, CIP_D int, id int")
    assert cols.cols_matching(df, "_d") == ["AZM_d", "CIP_D"]
    with pytest.raises(ValueError):
        cols.cols_matching(df, "_d", suffix=True)


CUTS = [("AMX", 2014, 19.0), ("AZM", 2014, None), ("CIP", 2015, 20.0)]


def test_interpretation_long(spark):
    cuts = literal_table(spark, CUTS, "ATB string, annee int, seuil double")
    long = literal_table(spark, [
        (1, 2014, "AMX", 17.0, None), (2, 2014, "AMX", 25.0, None), (3, 2014, "AMX", None, "S"),
        (4, 2014, "AMX", 19.0, "R"), (5, 2014, "AZM", 30.0, "S"), (6, 2014, "CIP", 10.0, "I"),
        (7, None, "CIP", 10.0, "s*")], "id int, year int, ATB string, diam double, SIR string")
    got = dict(rows(interpret.interpret(long, cuts), "id", "SIR"))
    assert got == {1: "R", 2: "S", 3: "S", 4: "S", 5: None, 6: "I", 7: "s*"}
    kept = interpret.interpret(long, cuts, drop_null_year=True)
    assert kept.count() == 6


def test_interpretation_wide_equals_long(spark):
    cuts = literal_table(spark, CUTS, "ATB string, annee int, seuil double")
    wide = literal_table(spark, [
        (1, 2014, 17.0, "S", 30.0, "S", 10.0, "I"), (2, 2015, 17.0, "S", None, None, 20.0, "R"),
        (3, None, 25.0, None, 3.0, "R", 19.9, "S")],
        "id int, year int, AMX_d double, AMX_SIR string, AZM_d double, AZM_SIR string, CIP_d double, CIP_SIR string")
    got = sorted(rows(interpret.interpret_wide(wide, cuts, ["AMX", "AZM", "CIP"]), "id", "AMX_SIR", "AZM_SIR", "CIP_SIR"))
    assert got == [(1, "R", None, "I"), (2, "S", None, "S"), (3, None, "R", "S")]


def test_repeated_threshold_is_an_error(spark):
    cuts = literal_table(spark, [*CUTS, ("AMX", 2014, 21.0)], "ATB string, annee int, seuil double")
    long = literal_table(spark, [(1, 2014, "AMX", 17.0, None)], "id int, year int, ATB string, diam double, SIR string")
    with pytest.raises(PySparkException):
        interpret.interpret(long, cuts).collect()


def test_harmonised_calls(spark):
    df = literal_table(spark, [("s",), ("S*",), ("i",), ("R",), ("?",), (None,)], "c string")
    out = interpret.harmonise_calls(df, ["c"])
    assert rows(out) == [("S",), ("S",), ("R",), ("R",), (None,), (None,)]
    assert rows(interpret.binary_status(out, ["c"])) == [(0,), (0,), (1,), (1,), (None,), (None,)]


def test_ages(spark):
    d = datetime.date
    df = literal_table(spark, [
        (d(2010, 6, 1), None, d(2000, 6, 2)), (None, d(2010, 6, 1), d(2011, 1, 1)), (d(2010, 6, 1), None, None)],
        "p date, r date, DN date")
    aged = derive.age_at_event(df, "p", "r", "DN")
    assert [r[0] for r in rows(aged, "age")] == [9, -1, None]
    clean = derive.sanitise_age(aged)
    assert rows(clean, "age", "DN") == [(9, d(2000, 6, 2)), (None, None), (None, None)]
    bins = derive.cross_category(derive.age_bins(literal_table(
        spark, [(14, "F"), (15, "M"), (49, "F"), (50, "M"), (20, None), (None, "F")], "age int, sexe string"),
        "age", fv.AGE_LEVELS), "age", "sexe")
    assert rows(bins, "age_cut", "age_sexe") == [
        ("< 15", "F_14less"), ("15-49", "M_15to49"), ("15-49", "F_15to49"), ("50 +", "M_50plus"), ("15-49", None), (None, None)]


def test_species(spark):
    df = literal_table(spark, [
        ("Shigella sonnei", None), (None, "Shigella flexneri 1c"), ("Shigella sp", "97-10607"), ("Shigella Rough", None),
        ("non agglutinable", None), ("Shigella non-serotypable", None), ("E. coli", "Ewing"), (None, None)],
        "espece string, Resultats string")
    out = derive.normalise_label(df, "espece", "Resultats", fv.GENUS_PATTERN, fv.SPECIES_PATTERN, fv.SPECIES_OVERRIDES,
                                 fv.SPECIES_SYNONYMS, ("g", "sp"))
    assert [r[0] for r in rows(out, "sp")] == [
        "sonnei", "flexneri", "dysenteriae", "rough", "nst", "non-serotypable", "boydii", None]
    split = derive.split_uninformative(out, "sp", fv.UNINFORMATIVE_SPECIES, "side")
    assert rows(split, "sp", "side")[3:5] == [(None, "rough"), (None, "nst")]


def test_first_match_rules(spark):
    df = literal_table(spark, [("CH institut",), ("Institut X",), ("Labo",), (None,), ("la faculté",), ("LIP",), ("centre hospitalier",)],
                       "labo string")
    out = derive.classify_first_match(df, "labo", fv.SETTING_RULES, fv.SETTING_DEFAULT)
    assert [r[0] for r in rows(out)] == ["hospitalise", "institut", "ville", None, "hospitalise", "institut", "hospitalise"]


def test_travel_and_groups(spark):
    df = literal_table(spark, [("Inde du Sud",), ("Pas de voyage",), ("Grèce",), ("Népal",), (None,)], "voyage string")
    out = derive.group_values(derive.normalise_travel(df, "voyage", fv.FOCUS_COUNTRY, fv.NO_TRAVEL_TEXT), "voyage", fv.COUNTRY_GROUPS, "g")
    assert rows(out) == [("inde", "asie"), ("aucun", "aucun"), ("grece", "europe"), ("nepal", "asie"), (None, None)]


def test_exposure_policies(spark):
    df = literal_table(spark, [("inde", "1"), ("maroc", "1"), ("aucun", "0"), ("non precise", "1"), (None, None)],
                       "voyage string, voyage_01 string")
    out = derive.missing_policies(df, "voyage_01", nl.in_set("voyage", fv.UNKNOWN_TRAVEL), fv.MISSING_CATEGORY)
    out = derive.nested_exposure(out, "voyage_01", nl.same("voyage", "inde"), "inde", "inde", fv.EXPOSURE_LABELS)
    assert rows(out, "inde", "inde_NA", "inde_m") == [
        ("inde", "inde", "inde"), ("autres voyages",) * 3, ("pas de voyage",) * 3,
        ("autres voyages", None, "missing_cat"), (None, None, "missing_cat")]


def test_subtype(spark):
    df = literal_table(spark, [
        ("flexneri", "1b", "x"), ("flexneri", "6", "x"), ("flexneri", None, "flexneri 2a 1b"), ("flexneri", None, None),
        ("sonnei", "1b", "x"), (None, "2a", "x")], "espece3 string, serotype string, espece string")
    out = derive.subtype_with_fallback(df, "espece3", "serotype", "espece", "flexneri", fv.SUBTYPES, "s")
    assert [r[0] for r in rows(out, "s")] == ["1b", "others", "1b", "others", None, None]


def test_geography(spark):
    df = literal_table(spark, [
        (False, None, None, "97410"), (True, "96", None, "75001"), (True, "978", None, "1"), (True, "75", "69002", "1"),
        (None, None, None, "13001")], "metrop boolean, d string, p string, l string")
    out = derive.resolve_geography(df, "d", "p", "l", "metrop", "96", ("978", "974"), "x")
    assert [r[0] for r in rows(out, "x")] == ["974", "750", "974", "690", None]


def test_frequency_table(spark):
    df = literal_table(spark, [("a",), ("a",), ("b",), (None,)], "v string")
    assert sorted(rows(agg.freq_table(df, "v"), "level", "freq", "percent"), key=str) == sorted(
        [("a", 2, 66.7), ("b", 1, 33.3), (None, 1, None)], key=str)
    assert agg.freq_table(df, "v", "no").count() == 2
    full = agg.freq_table(df.where("v = 'a'"), "v", "always", Levels.of(("a", "b")))
    assert sorted(rows(full, "level", "freq", "percent"), key=str) == sorted(
        [("a", 2, 100.0), ("b", 0, 0.0), (None, 0, None)], key=str)


def test_description(spark):
    df = literal_table(spark, [("a", 1), ("a", 0), ("b", 1), (None, 1)], "v string, r int")
    specs = [VariableSpec("v", "always", Levels.of(("a", "b", "c"))), VariableSpec("r", "no")]
    got = {(r["variable"], r["level"]): r["freq"] for r in describe(df, specs).collect()}
    assert got == {("v", "a"): "2 (66.7)", ("v", "b"): "1 (33.3)", ("v", "c"): "0 (0)", ("v", "missing"): "1",
                   ("r", "0"): "1 (25)", ("r", "1"): "3 (75)"}
    by = {(r["variable"], r["level"]): (r["R"], r["S"]) for r in describe_by(df, specs, {"R": ("r", 1), "S": ("r", 0)}).collect()}
    assert by[("v", "a")] == ("1 (50)", "1 (100)") and by[("v", "missing")] == ("1", "0")


def test_grid_keeps_zero_and_full_resistance(spark):
    counts = literal_table(spark, [("CIP", "a", 4, 0), ("CIP", "b", 3, 3), ("C3G", "a", 4, 1), ("CIP", None, 9, 9)],
                           "ATB string, sp string, n_tested long, n_resistant long")
    out = prevalence.resistance_grid(counts, "sp", "ATB", ["C3G", "CIP"], fv.DISPLAY_NAMES, fv.GRID_BINS)
    got = {(r["drug_name"], r["sp"]): (r["value"], r["value_cut"]) for r in out.collect()}
    assert got == {("CIP", "a"): (0.0, "0-25"), ("CIP", "b"): (100.0, "75-100"), ("3GC", "a"): (25.0, "25-50")}


def test_yearly_shares_add_up(spark):
    counts = literal_table(spark, [(2010, "a", 6, 2), (2010, "b", 3, 0), (2010, None, 1, 1), (2011, "a", 5, 5)],
                           "y int, sp string, n_tested long, n_resistant long")
    out = prevalence.yearly_resistance(counts, "y", "sp").orderBy("y", F.col("sp").asc_nulls_last()).collect()
    assert [(r["sp"], r["sp_perc_resist"], r["cum_perc_resist"]) for r in out] == [
        ("a", 0.2, 0.2), (None, 0.1, 0.3), ("a", 1.0, 1.0)]
    assert abs(sum(r["sp_perc_resist"] for r in out if r["y"] == 2010) - out[0]["yr_perc_resist"]) < 1e-12
    assert prevalence.yearly_resistance(counts, "y", "sp", keep_zero=True).count() == 4


def test_corrections(spark):
    df = literal_table(spark, [("1", 5.0, "x"), ("2", 6.0, "y"), ("3", None, "z")], "k string, d double, o string")
    fixes = literal_table(spark, [("1", 9.0), ("2", None), ("3", 7.0)], "k string, d double")
    out = joins.apply_corrections(df, fixes, "k", ["d"])
    assert out.columns == df.columns and sorted(rows(out)) == [("1", 9.0, "x"), ("2", 6.0, "y"), ("3", 7.0, "z")]
    twice = fixes.unionByName(fixes)
    with pytest.raises(PySparkException):
        joins.apply_corrections(df, twice, "k", ["d"]).collect()


def test_null_key_meets_null_key(spark):
    df = literal_table(spark, [("a",), (None,)], "k string")
    dim = literal_table(spark, [("a", 1), (None, 2)], "k string, v int")
    assert sorted(rows(joins.enrich(df, dim, "k")), key=str) == sorted([("a", 1), (None, 2)], key=str)


@pytest.mark.parametrize("hot_rows", [5_000_000, 3, 1])
def test_group_size_with_hot_and_null_keys(spark, hot_rows):
    data = [(i, "hot" if i % 3 == 0 else (None if i % 5 == 0 else f"k{i % 11}")) for i in range(300)]
    df = literal_table(spark, data, "id int, k string")
    got = dict(rows(windows.group_size(df, ["k"], "id", "n", hot_rows), "id", "n"))
    want = {i: None if k is None else sum(k == other for _, other in data) for i, k in data}
    assert got == want


@pytest.mark.parametrize("hot_rows", [5_000_000, 2])
def test_duplicates_with_hot_person(spark, hot_rows):
    data = [(i, None if i % 7 == 0 else ("p" if i % 2 else f"q{i % 10}"), i % 3, None if i % 4 else "s") for i in range(120)]
    df = literal_table(spark, data, "id int, person string, a int, b string")
    out = derive.flag_duplicates(df, "person", ["a", "b"], "id", hot_rows=hot_rows)
    got = {r["id"]: (r["n_person"], r["n_same"], r["is_repeat"]) for r in out.collect()}
    for i, p, a, b in data:
        mates = [r for r in data if r[1] == p]
        twins = [r for r in mates if r[2:] == (a, b)]
        want = (None, None, False) if p is None else (len(mates), len(twins), i > min(t[0] for t in twins))
        assert got[i] == want
    kept = derive.flag_duplicates(df, "person", ["a", "b"], "id", drop=True, hot_rows=hot_rows)
    assert kept.count() == sum(not v[2] for v in got.values())


def test_person_key_hides_names(spark):
    df = literal_table(spark, [("A", "B"), ("AB", ""), (None, None)], "n string, p string")
    keys = [r[0] for r in rows(derive.person_key(df, ["n", "p"]), "person_key")]
    assert keys[0] != keys[1] and keys[2] is None and len(keys[0]) == 64


def test_sample_is_stable_over_layouts(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 4).alias("g"))
    first = sorted(rows(ordering.sample_per_group(df, ["g"], 4, "id", seed=3), "id"))
    again = sorted(rows(ordering.sample_per_group(df.repartition(13), ["g"], 4, "id", seed=3), "id"))
    assert first == again and len(first) == 16
    assert first != sorted(rows(ordering.sample_per_group(df, ["g"], 4, "id", seed=4), "id"))


def test_reshape_round_trip(spark):
    wide = literal_table(spark, [(1, 0, None), (2, 1, 1)], "id int, A_SIR int, B_SIR int")
    long = derive.long_status(wide, ["id"])
    assert sorted(rows(long)) == [(1, "A_SIR", 0), (2, "A_SIR", 1), (2, "B_SIR", 1)]
    back = reshape.to_wide(long, ["id"], "ATB", ["A_SIR", "B_SIR"], "status")
    assert sorted(rows(back), key=str) == sorted(rows(wide), key=str)


def test_group_function(spark):
    df = literal_table(spark, [("a", 1), ("a", 2), ("b", 5)], "g string, n int")
    out = reshape.group_function(df, ["g"], lambda p: p.groupby("g", as_index=False)["n"].sum(), "g string, n long")
    assert sorted(rows(out)) == [("a", 3), ("b", 5)]


def test_wide_counts_equal_long_counts(spark):
    wide = literal_table(spark, [(1, "x", 0, None), (2, "x", 1, 1), (3, "y", None, None), (4, "y", None, 0)],
                         "id int, g string, A_SIR int, B_SIR int")
    a = agg.tested_resistant_wide(wide, ["g"], {"A_SIR": "A_SIR", "B_SIR": "B_SIR"})
    b = agg.tested_resistant(derive.long_status(wide, ["id", "g"]), "g", "ATB")
    assert sorted(rows(a, "g", "ATB", "n_tested", "n_resistant")) == sorted(rows(b, "g", "ATB", "n_tested", "n_resistant"))


def test_mic(spark):
    df = literal_table(spark, [(">256",), ("0,5",), ("supeq32",), ("64",), (None,), ("?",)], "m string")
    out = derive.censor_mic(df, "m", "v", cap_text="supeq32", cap=32.0)
    assert [r[0] for r in rows(out, "v")] == [32.0, 0.5, 32.0, 32.0, None, None]
    free = derive.censor_mic(df, "m", "v")
    assert [r[0] for r in rows(free.select(derive.mic_label("v")))] == [">256", "0.5", None, "64", None, None]
    levels = mic.mic_distribution(literal_table(spark, [("1",), ("2",), ("2",), ("9",)], "m string"), "m", ("1", "2", "4"))
    assert sorted(rows(levels)) == [(1, "1", 1, 4), (2, "2", 2, 4), (3, "4", 0, 4)]


def test_quality_checks(spark):
    d = datetime.date
    df = literal_table(spark, [(1, d(2010, 1, 1), d(2010, 2, 1)), (2, d(2010, 1, 1), d(2012, 1, 1)), (3, d(2010, 1, 1), d(2009, 12, 31)),
                               (4, None, d(2009, 1, 1))], "id int, p date, r date")
    assert sorted(rows(quality.date_incoherence(df, "p", "r"), "id", "diff_date")) == [(2, 2), (3, -1)]


def test_quartiles_interpolate(spark):
    df = literal_table(spark, [(1,), (2,), (3,), (4,), (None,)], "x int")
    assert rows(agg.quartiles(df, "x")) == [(1.75, 2.5, 3.25)]
