"""Cleaning, interpretation, derivation, join and reshape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilar.functions import nulls as nl
from vigilar.functions import text as tx
from vigilar.functions.levels import Levels, with_levels
from vigilar.operators import columns as cols
from vigilar.operators import derive, filters, interpret, joins, ordering, quality, reshape, windows
from vigilar.operators.aggregate import collapse, count_by, tested_resistant
from vigilar.plans import fixed_values as fv
from vigilar.plans.surveillance import model_cohort, travel_review
from vigilar.sources.tables import clean_breakpoints, literal_table

from . import views as v
from . import views_sql as s
from .registry import query


# ---------------------------------------------------------------- sources

@query(f"WITH {s.BREAKPOINTS} SELECT ATB, annee, CASE WHEN ATB <> 'GEN' THEN seuil END AS seuil, n_lines "
       "FROM breakpoints JOIN (SELECT l_linenumber, count(*) AS n_lines FROM lineitem GROUP BY 1) ON "
       "ATB = CASE l_linenumber WHEN 1 THEN 'CIP' WHEN 2 THEN 'AZM' WHEN 3 THEN 'CTX' WHEN 4 THEN 'CRO' "
       "WHEN 6 THEN 'NAL' WHEN 7 THEN 'GEN' END")
def load_breakpoints(spark, sf):
    """Thresholds restricted to drugs present, one drug voided, with the lines they apply to."""
    text = literal_table(spark, [(d, str(y), None if c is None else str(c).replace(".", ","))
                                 for d, y, c in v.THRESHOLDS], "drug string, year string, cut string")
    cuts = clean_breakpoints(text, [d for d in v.DRUGS.values() if d != "CAZ10"], voided=["GEN"])
    code = cols.case_when(*[(F.col("l_linenumber") == i, d) for i, d in v.DRUGS.items()])
    lines = v.table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n_lines"))
    return cuts.join(lines.select(code.alias("__d"), "n_lines"), F.col("ATB") == F.col("__d")).drop("__d")


@query("SELECT l_linenumber, count(*) AS n, min(CAST(l_shipdate AS DATE)) AS first_day, max(l_quantity) AS largest "
       "FROM lineitem GROUP BY l_linenumber")
def load_table(spark, sf):
    from vigilar.sources.tables import load_table as load
    lines = load(spark, f"{sf}/lineitem.parquet",
                 "l_linenumber int, l_quantity double, l_shipdate timestamp_ntz")
    return lines.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.to_date("l_shipdate")).alias("first_day"),
        F.max("l_quantity").alias("largest"))


# ---------------------------------------------------------------- diameters and calls

_INTERPRETED = s.RESULTS + ", " + s.BREAKPOINTS + """,
called AS (SELECT t.row_id, t.year, t.ATB, nullif(t.diam, 0) AS diam,
  CASE upper(CASE WHEN b.ATB IS NULL THEN t.SIR WHEN b.seuil IS NULL THEN NULL
    WHEN nullif(t.diam, 0) < b.seuil THEN 'R' WHEN nullif(t.diam, 0) IS NOT NULL THEN 'S' ELSE t.SIR END)
    WHEN 'S' THEN 'S' WHEN 'S*' THEN 'S' WHEN 'R' THEN 'R' WHEN 'I' THEN 'R' END AS SIR
  FROM tst t LEFT JOIN breakpoints b ON t.ATB = b.ATB AND t.year = b.annee)"""


def _interpreted(spark, sf):
    long = derive.zero_as_missing(v.results_long(spark, sf), ["diam"])
    called = interpret.interpret(long, v.breakpoints(spark))
    return called.withColumn("SIR", interpret.harmonise_call("SIR"))


@query(f"WITH {_INTERPRETED} SELECT ATB, year, SIR, CASE SIR WHEN 'S' THEN 0 WHEN 'R' THEN 1 END AS status, "
       "count(*) AS n, sum(row_id) AS key_sum FROM called GROUP BY ALL")
def interpret_breakpoints(spark, sf):
    called = _interpreted(spark, sf).withColumn("status", interpret.binary_call("SIR"))
    return called.groupBy("ATB", "year", "SIR", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("key_sum"))


@query(f"WITH {s.ANALYSIS} SELECT row_id, {', '.join(s.ALL_STATUS)}, AZM_d FROM iso")
def interpret_wide(spark, sf):
    """The whole cleaning plan, statuses of every isolate."""
    return v.isolates(spark, sf).select("row_id", *v.ALL_STATUS, "AZM_d")


@query(f"WITH {s.RAW}, x AS (SELECT unnest([{', '.join(f'{d}_SIR' for d in v.DRUGS.values())}]) AS recorded FROM raw) "
       "SELECT recorded, CASE upper(recorded) WHEN 'I' THEN 'R' WHEN 'R' THEN 'R' WHEN 'S' THEN 'S' WHEN 'S*' THEN 'S' END "
       "AS call, count(*) AS n FROM x GROUP BY ALL")
def harmonise_calls(spark, sf):
    long = v.results_long(spark, sf).select(F.col("SIR").alias("recorded"))
    return long.groupBy("recorded").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "call", interpret.harmonise_call("recorded"))


@query(f"WITH {s.RAW} SELECT row_id, {', '.join(f'nullif({d}_d, 0) AS {d}_d' for d in v.DRUGS.values())} FROM raw")
def zero_as_missing(spark, sf):
    raw = v.raw_isolates(spark, sf)
    wide = cols.cols_matching(raw, "_d", suffix=True)
    return derive.zero_as_missing(raw, wide).select("row_id", *wide)


@query("WITH wide AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders), "
       "fixes AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice) END AS p "
       "FROM orders WHERE o_orderkey % 10 < 3) "
       "SELECT o_orderkey, coalesce(p, o_totalprice) AS o_totalprice, o_orderstatus FROM wide LEFT JOIN fixes ON o_orderkey = k")
def corrections_override(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    fixes = orders.where(F.col("o_orderkey") % 10 < 3).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.round("o_totalprice")).alias("o_totalprice"))
    return joins.apply_corrections(orders, fixes, "o_orderkey", ["o_totalprice"])


@query(f"WITH {s.RAW}, b AS (SELECT row_id, {', '.join(f'''CASE upper({d}_SIR) WHEN 'R' THEN 1 WHEN 'I' THEN 1 WHEN 'S' THEN 0 WHEN 'S*' THEN 0 END AS {d}''' for d in v.DRUGS.values())} FROM raw) "
       "SELECT greatest(coalesce(CIP, AZM), CTX, CRO) AS class_status, coalesce(CIP, AZM) AS merged, count(*) AS n, "
       "sum(row_id) AS key_sum FROM b GROUP BY ALL")
def class_resistance(spark, sf):
    """Merge two equivalent drugs, then resistant to at least one of the class."""
    raw = v.raw_isolates(spark, sf)
    calls = [f"{d}_SIR" for d in v.DRUGS.values()]
    bits = interpret.binary_status(interpret.harmonise_calls(raw, calls), calls)
    merged = derive.merge_equivalent(bits, {"MRG": ("CIP", "AZM")})
    out = derive.class_resistance(merged, ["MRG_SIR", "CTX_SIR", "CRO_SIR"], "class_status")
    return out.groupBy("class_status", F.col("MRG_SIR").alias("merged")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("key_sum"))


# ---------------------------------------------------------------- derivations

@query(f"WITH {s.ANALYSIS} SELECT row_id, age, DN, year_real, CAST(year(Date_rec) AS INTEGER) - CAST(year(Date_prel) AS INTEGER) "
       "AS year_gap FROM iso")
def age_and_year(spark, sf):
    return v.isolates(spark, sf, drugs=False).select(
        "row_id", "age", "DN", "year_real", (F.year("Date_rec") - F.year("Date_prel")).alias("year_gap"))


@query(f"WITH {s.CLEAN} SELECT espece3, info_espece_autre, CASE WHEN contains(espece, 'Shigella') THEN 'Shigella' END AS espece2, "
       "count(*) AS n, sum(row_id) AS key_sum FROM cleaned GROUP BY ALL")
def label_normalise(spark, sf):
    return v.cleaned(spark, sf, drugs=False).groupBy("espece2", "espece3", "info_espece_autre").agg(
        F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("key_sum"))


_WORDS = "the|and|le|la|der|die|el|los"


@query(f"SELECT doc_id, lower(nullif(regexp_extract(text, '{_WORDS}'), '')) AS word, "
       "regexp_matches(text, '(?i)licen[sc]e') AS has_license, length(regexp_replace(text, '[0-9]+', '#', 'g')) AS n_masked, "
       "md5(regexp_replace(text, '[aeiou]', '_')) AS first_vowel, upper(lang) AS lang, substr(text, 2, 4) AS piece FROM documents")
def text_functions(spark, sf):
    """Extraction, detection, replace-all, replace-first and substring over whole documents."""
    docs = v.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return docs.select(
        "doc_id", F.lower(nl.extract("text", _WORDS)).alias("word"),
        nl.matches("text", "(?i)licen[sc]e").alias("has_license"),
        F.length(tx.replace_all("text", "[0-9]+", "#")).alias("n_masked"),
        F.md5(tx.replace_first("text", "[aeiou]", "_")).alias("first_vowel"),
        F.upper("lang").alias("lang"), tx.part("text", 2, 5).alias("piece"))


@query("SELECT p_name, CASE WHEN regexp_matches(p_name, '^re|bolt') THEN 'first' WHEN regexp_matches(p_name, '(?i:RING)|pl.te') THEN 'second' "
       "WHEN p_name IS NOT NULL THEN 'other' END AS kind, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 9 <> 0 THEN p_name END "
       "AS p_name FROM part) GROUP BY ALL")
def classify_first_match(spark, sf):
    part = v.table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 9 != 0, F.col("p_name")).alias("p_name"))
    rules = (("first", ("^re", "bolt")), ("second", ("(?i)RING", "pl.te")))
    return count_by(derive.classify_first_match(part, "p_name", rules, "other", "kind"), "p_name", "kind")


@query(f"WITH {s.ANALYSIS} SELECT labo, voyage, continent, voyage_01, count(*) AS n FROM iso GROUP BY ALL")
def enrich_travel(spark, sf):
    return count_by(v.isolates(spark, sf, drugs=False), "labo", "voyage", "continent", "voyage_01")


@query(f"WITH {s.CLEAN} SELECT voyage, voyage_continent, count(*) AS n FROM cleaned GROUP BY ALL")
def group_values(spark, sf):
    return count_by(v.cleaned(spark, sf, drugs=False), "voyage", "voyage_continent")


@query(f"WITH {s.ANALYSIS} SELECT row_id, metrop, departement, CP_patient, departement_bis FROM iso")
def resolve_geography(spark, sf):
    return v.isolates(spark, sf, drugs=False).select(
        "row_id", "metrop", "departement", "CP_patient", "departement_bis")


@query(f"WITH {s.ANALYSIS} SELECT voyage, voyage_01, voyage_01_NA, voyage_01_m, count(*) AS n FROM iso GROUP BY ALL")
def missing_policies(spark, sf):
    return count_by(v.isolates(spark, sf, drugs=False), "voyage", "voyage_01", "voyage_01_NA", "voyage_01_m")


@query(f"WITH {s.ANALYSIS} SELECT voyage, inde, inde_NA, inde_m, asie, asie_NA, asie_m, "
       "CASE inde WHEN 'inde' THEN 1 WHEN 'pas de voyage' THEN 2 WHEN 'autres voyages' THEN 3 END AS inde_ref_rank, "
       "CAST(coalesce(voyage = 'inde', FALSE) AS INTEGER) AS focus_flag, count(*) AS n FROM iso GROUP BY ALL")
def nested_exposure(spark, sf):
    order = Levels.of(("pas de voyage", "autres voyages", "inde"), reference="inde")
    table = derive.focus_flag(v.isolates(spark, sf, drugs=False), "voyage", fv.FOCUS_COUNTRY, "focus_flag")
    table = with_levels(table, "inde_ref", order, "inde_ref_rank").withColumn(
        "inde_ref_rank", F.col("inde_ref_rank").cast("int"))
    return count_by(table, "voyage", "inde", "inde_NA", "inde_m", "asie", "asie_NA", "asie_m", "inde_ref_rank",
                    "focus_flag")


@query(f"WITH {s.ANALYSIS} SELECT year_real, year_real_cut, age_cut, count(*) AS n FROM iso GROUP BY ALL")
def bins(spark, sf):
    return count_by(v.isolates(spark, sf, drugs=False), "year_real", "year_real_cut", "age_cut")


@query(f"WITH {s.ANALYSIS} SELECT age_cut, sexe, age_sexe, count(*) AS n FROM iso GROUP BY ALL")
def cross_category(spark, sf):
    return count_by(v.isolates(spark, sf, drugs=False), "age_cut", "sexe", "age_sexe")


@query(f"WITH {s.ANALYSIS} SELECT espece, espece3, serotype, serotype_flexneri, count(*) AS n FROM iso GROUP BY ALL")
def subtype_fallback(spark, sf):
    return count_by(v.isolates(spark, sf, drugs=False), "espece", "espece3", "serotype", "serotype_flexneri")


@query(f"WITH {s.CLEAN} SELECT voyage, count(*) AS n FROM cleaned WHERE CAZ1030_SIR = 'R' OR CTX_SIR = 'R' OR CRO_SIR = 'R' "
       "OR CIP_SIR = 'R' OR AZM_SIR = 'R' GROUP BY voyage", name="travel_review")
def _travel_review(spark, sf):
    return travel_review(v.cleaned(spark, sf))


@query(f"WITH {s.CLEAN} SELECT voyage_continent, count(*) AS n FROM cleaned WHERE CAZ1030_SIR = 'R' OR CTX_SIR = 'R' OR CRO_SIR = 'R' "
       "OR CIP_SIR = 'R' OR AZM_SIR = 'R' GROUP BY voyage_continent")
def travel_review_continent(spark, sf):
    """The same review by group of countries."""
    return travel_review(v.cleaned(spark, sf), "voyage_continent")


@query(f"""WITH {s.RAW}, g AS (SELECT CASE WHEN lower(origine_prel) = 'selles' THEN 'stool'
  WHEN lower(origine_prel) = 'biopsie rectale' THEN 'other digestive' WHEN lower(origine_prel) = 'sang' THEN 'other'
  WHEN lower(origine_prel) = 'autre' OR origine_prel IS NULL THEN 'undetermined' ELSE 'unlisted' END AS specimen FROM raw)
  SELECT specimen, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM g GROUP BY specimen""")
def specimen_groups(spark, sf):
    return derive.specimen_groups(v.raw_isolates(spark, sf, drugs=False), "origine_prel", fv.SPECIMEN_GROUPS)


@query(f"""WITH {s.ANALYSIS}, l AS (SELECT CASE WHEN contains(lower(espece), 'sonnei g') THEN 'sonnei g'
  ELSE trim(regexp_replace(lower(espece), 'shigella', '')) END AS level FROM iso WHERE metrop AND espece IS NOT NULL)
  SELECT level, count(*) AS n FROM l GROUP BY level ORDER BY n DESC, level""")
def text_label_counts(spark, sf):
    rows = v.isolates(spark, sf, drugs=False).where("metrop")
    counts = derive.text_label_counts(rows, "espece", "shigella", fv.SEROTYPE_TEXT_FIXES)
    return ordering.frequency_sort(counts)


@query(f"""WITH {s.ANALYSIS} SELECT CASE WHEN espece3 = 'sonnei' THEN 'sonnei' ELSE 'flexneri_' || coalesce(serotype_flexneri, 'NA') END
  AS label, count(*) AS n FROM iso WHERE metrop AND espece3 IN ('sonnei', 'flexneri') GROUP BY ALL""")
def combined_label(spark, sf):
    rows = v.isolates(spark, sf, drugs=False).where(F.col("metrop") & F.col("espece3").isin("sonnei", "flexneri"))
    return count_by(derive.combined_label(rows, "espece3", "serotype_flexneri", "sonnei"), "label")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 11 <> 0 THEN o_custkey END AS person, o_orderpriority, o_orderstatus FROM orders),
  c AS (SELECT *, count(*) OVER (PARTITION BY person) AS np, count(*) OVER (PARTITION BY person, o_orderpriority, o_orderstatus) AS ns,
  min(o_orderkey) OVER (PARTITION BY person, o_orderpriority, o_orderstatus) AS first FROM o)
  SELECT o_orderkey, person, o_orderpriority, o_orderstatus, CASE WHEN person IS NOT NULL THEN np END AS n_person,
  CASE WHEN person IS NOT NULL THEN ns END AS n_same, person IS NOT NULL AND o_orderkey > first AS is_repeat FROM c""")
def flag_duplicates(spark, sf):
    orders = v.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("person"),
        "o_orderpriority", "o_orderstatus")
    return derive.flag_duplicates(orders, "person", ["o_orderpriority", "o_orderstatus"], "o_orderkey")


@query("""WITH d AS (SELECT doc_id, sha256(text) AS person_key, lang FROM documents),
  c AS (SELECT *, count(*) OVER (PARTITION BY person_key) AS np, count(*) OVER (PARTITION BY person_key, lang) AS ns,
  min(doc_id) OVER (PARTITION BY person_key, lang) AS first FROM d)
  SELECT doc_id, person_key, lang, np AS n_person, ns AS n_same FROM c WHERE doc_id = first""")
def drop_duplicates(spark, sf):
    """Exact copies of a text: only the first record of each set stays."""
    docs = derive.person_key(v.table(spark, sf, "documents"), ["text"]).select("doc_id", "person_key", "lang")
    return derive.flag_duplicates(docs, "person_key", ["lang"], "doc_id", drop=True).drop("is_repeat")


# ---------------------------------------------------------------- joins

@query("""SELECT n_name, n_regionkey, r_name FROM (SELECT n_name, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey END AS n_regionkey FROM nation)
  LEFT JOIN (SELECT CASE WHEN r_regionkey <> 2 THEN r_regionkey END AS k, r_name FROM region) ON n_regionkey IS NOT DISTINCT FROM k""")
def null_safe_join(spark, sf):
    nation = v.table(spark, sf, "nation").select(
        "n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("n_regionkey"))
    region = v.table(spark, sf, "region").select(
        F.when(F.col("r_regionkey") != 2, F.col("r_regionkey")).alias("k"), "r_name")
    return joins.enrich(nation, region, "n_regionkey", "k")


@query(f"""WITH {s.ANALYSIS}, g AS (SELECT metrop, espece3, count(*) AS tot FROM iso GROUP BY ALL),
  h AS (SELECT metrop, espece3, count(*) AS n FROM iso WHERE GEN_SIR = 1 AND NAL_SIR = 1 AND CIP_SIR = 1 AND AZM_SIR = 1 GROUP BY ALL)
  SELECT g.metrop, g.espece3, tot, coalesce(n, 0) AS n FROM g LEFT JOIN h ON g.metrop = h.metrop AND g.espece3 IS NOT DISTINCT FROM h.espece3""")
def keep_all_groups(spark, sf):
    table = v.isolates(spark, sf)
    groups = count_by(table, "metrop", "espece3", n="tot")
    all_four = (F.col("GEN_SIR") == 1) & (F.col("NAL_SIR") == 1) & (F.col("CIP_SIR") == 1) & (F.col("AZM_SIR") == 1)
    return joins.keep_all_groups(count_by(table.where(all_four), "metrop", "espece3"), groups,
                                 ["metrop", "espece3"], ["n"])


@query("""WITH a AS (SELECT o_orderpriority AS k, count(*) AS n_urgent FROM orders WHERE o_orderpriority <= '3' GROUP BY 1),
  b AS (SELECT o_orderpriority AS k, count(*) AS n_late FROM orders WHERE o_orderpriority >= '2' GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, n_urgent, n_late FROM a FULL JOIN b ON a.k = b.k""")
def full_merge(spark, sf):
    orders = v.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "k")
    a = count_by(orders.where(F.col("k") <= "3"), "k", n="n_urgent")
    b = count_by(orders.where(F.col("k") >= "2"), "k", n="n_late")
    return joins.full_merge(a, b, ["k"])


@query("""SELECT t.variable, t.level_rank, t.level, a.n AS n_early, b.n AS n_late FROM (VALUES ('status', 1, 'F'), ('status', 2, 'O'), ('status', 3, 'P'),
  ('status', 4, 'X')) t(variable, level_rank, level) LEFT JOIN (SELECT o_orderstatus AS l, count(*) AS n FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1) a ON a.l = t.level
  LEFT JOIN (SELECT o_orderstatus AS l, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1998 AND o_orderstatus <> 'P' GROUP BY 1) b ON b.l = t.level""")
def stack_side_by_side(spark, sf):
    template = ordering.report_template(spark, {"status": ["F", "O", "P", "X"]})
    orders = v.table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "level")
    early = F.year("o_orderdate") < 1998
    tables = [count_by(orders.where(early), "level", n="n_early"),
              count_by(orders.where(~early & (F.col("level") != "P")), "level", n="n_late")]
    return joins.stack_side_by_side(template, tables, ["level"])


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY 1 HAVING sum(p_size) % 2 = 0) GROUP BY 1")
def semi_join(spark, sf):
    part = v.table(spark, sf, "part")
    members = part.groupBy("p_type").agg(F.sum("p_size").alias("t")).where(F.col("t") % 2 == 0)
    return count_by(joins.semi_by(part, members, "p_type"), "p_brand")


# ---------------------------------------------------------------- reshape

@query(f"WITH {s.RESULTS} SELECT ATB, year, count(*) AS n, count(diam) AS n_diam, sum(diam) AS sum_diam FROM tst GROUP BY ALL")
def to_long(spark, sf):
    """Unpivot of the raw diameters, then summed per drug and year."""
    raw = v.raw_isolates(spark, sf)
    wide = cols.cols_matching(raw, "_d", suffix=True)
    long = reshape.to_long(raw, ["row_id", "year"], wide, "ATB", "diam")
    return long.groupBy(tx.replace_first("ATB", "_d$").alias("ATB"), "year").agg(
        F.count(F.lit(1)).alias("n"), F.count("diam").alias("n_diam"), F.sum("diam").alias("sum_diam"))


@query(f"WITH {s.RESULTS} SELECT row_id, {', '.join(f'max(diam) FILTER (ATB = {chr(39)}{d}{chr(39)}) AS {d}' for d in v.DRUGS.values())} FROM tst GROUP BY row_id")
def to_wide(spark, sf):
    return reshape.to_wide(v.results_long(spark, sf), ["row_id"], "ATB", list(v.DRUGS.values()), "diam")


@query(f"""WITH {s.ANALYSIS}, g AS (SELECT y AS year_real, sp AS espece3 FROM (SELECT unnest(range(1994, 2003)) AS y), (SELECT unnest(['sonnei', 'flexneri', 'boydii', 'dysenteriae']) AS sp))
  SELECT CAST(g.year_real AS INTEGER) AS year_real, g.espece3, coalesce(n, 0) AS n FROM g LEFT JOIN (SELECT year_real, espece3, count(*) AS n FROM iso WHERE NOT metrop GROUP BY ALL) c
  ON g.year_real = c.year_real AND g.espece3 = c.espece3""")
def complete_levels(spark, sf):
    counts = count_by(v.isolates(spark, sf, drugs=False).where(~F.col("metrop")), "year_real", "espece3")
    return reshape.complete_levels(counts, ["n"], year_real=list(range(1994, 2003)),
                                   espece3=["sonnei", "flexneri", "boydii", "dysenteriae"])


@query("""SELECT 'order' AS kind, o_orderstatus AS code, count(*) AS n, NULL AS total FROM orders GROUP BY 2 UNION ALL
  SELECT 'line', l_linestatus, NULL, sum(l_quantity) FROM lineitem GROUP BY 2""")
def union_tables(spark, sf):
    orders = v.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("code")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("order"))
    lines = v.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("code")).agg(
        F.sum("l_quantity").alias("total")).withColumn("kind", F.lit("line"))
    return reshape.union_tables(orders, lines)


# ---------------------------------------------------------------- filters and columns

@query(f"WITH {s.ANALYSIS} SELECT row_id, CIP_SIR, age_cut, sexe, voyage_01_NA FROM iso WHERE CIP_SIR IS NOT NULL AND age_cut IS NOT NULL AND sexe IS NOT NULL AND voyage_01_NA IS NOT NULL")
def complete_cases(spark, sf):
    needed = ["CIP_SIR", "age_cut", "sexe", "voyage_01_NA"]
    return filters.complete_cases(v.isolates(spark, sf), needed).select("row_id", *needed)


@query(f"""WITH {s.RAW} SELECT row_id, CASE WHEN coalesce(Date_rec < DATE '1997-01-01', FALSE) THEN NULL ELSE AZM_d END AS AZM_d,
  CASE WHEN coalesce(Date_rec < DATE '1997-01-01', FALSE) THEN NULL ELSE AZM_SIR END AS AZM_SIR FROM raw""")
def conditional_void(spark, sf):
    raw = v.raw_isolates(spark, sf)
    early = F.col("Date_rec") < F.lit("1997-01-01").cast("date")
    return cols.conditional_void(raw, early, ["AZM_d", "AZM_SIR"]).select("row_id", "AZM_d", "AZM_SIR")


@query("SELECT CASE WHEN o_orderstatus NOT IN ('P') THEN o_orderstatus END AS sexe, count(*) AS n FROM orders GROUP BY 1")
def void_codes(spark, sf):
    orders = v.table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "sexe")
    return count_by(derive.void_codes(orders, "sexe", ["P"]), "sexe")


@query(f"WITH {s.CLEAN} SELECT row_id FROM cleaned WHERE CTX_SIR = 'R' OR CRO_SIR = 'R' OR GEN_SIR = 'R'")
def any_of(spark, sf):
    return filters.any_of(v.cleaned(spark, sf), ["CTX_SIR", "CRO_SIR", "GEN_SIR"], "R").select("row_id")


@query(f"""WITH {s.ANALYSIS} SELECT coalesce(espece3, '0(0)') AS espece3, coalesce(F, '0(0)') AS F, coalesce(M, '0(0)') AS M FROM
  (SELECT espece3, CAST(max(n) FILTER (sexe = 'F') AS VARCHAR) AS F, CAST(max(n) FILTER (sexe = 'M') AS VARCHAR) AS M FROM
  (SELECT espece3, sexe, count(*) AS n FROM iso WHERE NOT (espece3 = 'boydii' AND sexe = 'F') OR espece3 IS NULL GROUP BY ALL) GROUP BY espece3)""")
def fill_all(spark, sf):
    rows = v.isolates(spark, sf, drugs=False).where(
        ~((F.col("espece3") == "boydii") & (F.col("sexe") == "F")) | F.col("espece3").isNull())
    return cols.fill_all(reshape.to_wide(count_by(rows, "espece3", "sexe"), ["espece3"], "sexe", ["F", "M"], "n"), "0(0)")


@query(f"WITH {s.LONG} SELECT row_id, year_real, espece3, ATB, status FROM dl WHERE metrop AND year_real BETWEEN 1996 AND 1999 AND ATB IN ('CIP_SIR', 'C3G_SIR')")
def filter_set(spark, sf):
    long = v.long_isolates(spark, sf)
    return filters.keep(long, F.col("metrop"), F.col("year_real").between(1996, 1999),
                        F.col("ATB").isin("CIP_SIR", "C3G_SIR")).select(
        "row_id", "year_real", "espece3", "ATB", "status")


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[Ll]icense') ")
def regex_filter(spark, sf):
    return filters.regex_filter(v.table(spark, sf, "documents"), "text", r"[Ll]icense").select("doc_id", "lang")


@query(f"""WITH {s.LONG} SELECT 'all' AS population, status, count(*) AS n FROM dl WHERE metrop AND ATB = 'AZM_SIR' AND espece3 IN ('sonnei', 'flexneri') GROUP BY ALL
  UNION ALL SELECT 'complete', status, count(*) FROM dl WHERE metrop AND ATB = 'AZM_SIR' AND espece3 IN ('sonnei', 'flexneri')
  AND age_cut IS NOT NULL AND sexe IS NOT NULL AND voyage_01_m IS NOT NULL AND year_real IS NOT NULL GROUP BY ALL""")
def cohort_long(spark, sf):
    """The macrolide model population and its complete records."""
    everyone, complete = model_cohort(v.long_isolates(spark, sf), "AZM")
    tagged = everyone.select(F.lit("all").alias("population"), "status").unionByName(
        complete.select(F.lit("complete").alias("population"), "status"))
    return count_by(tagged, "population", "status")


@query("""SELECT o_orderstatus AS state, o_orderkey AS key, TRY_CAST(replace(substr(o_orderpriority, 1, 1), '5', 'x') AS INTEGER) AS rank,
  coalesce(TRY_CAST(replace(substr(o_orderpriority, 1, 1), '5', 'x') AS INTEGER), -1) AS rank_filled FROM orders""")
def schema_ops(spark, sf):
    """Select, drop, rename by name and position, safe cast, coalesce."""
    orders = cols.drop_columns(v.table(spark, sf, "orders"), ["o_totalprice", "o_orderdate"])
    out = orders.withColumn("rank", tx.replace_all(tx.part("o_orderpriority", 1, 1), "5", "x"))
    out = cols.safe_cast(out, {"rank": "int"}).withColumn("none", F.lit(-1))
    out = cols.coalesce_columns(out, "rank_filled", ["rank", "none"]).drop("none", "o_custkey", "o_orderpriority")
    out = cols.rename(out, {"o_orderstatus": "state"}, by_position={1: "key"})
    return cols.select_first(out, ["state", "key"])


@query("""SELECT l_linenumber, CAST(floor(l_quantity / 7) AS BIGINT) AS band, CAST(year(l_shipdate) AS INTEGER) AS year, date_diff('day', o_orderdate, l_shipdate) AS lag,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END || '-' || coalesce(CAST(l_linenumber AS VARCHAR), 'NA') AS maybe,
  coalesce(CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END, 'NA') || '_' || l_linestatus AS pasted, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def scalar_functions(spark, sf):
    lines = v.table(spark, sf, "lineitem").join(
        v.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return lines.groupBy(
        "l_linenumber", F.floor(F.col("l_quantity") / 7).alias("band"), F.year("l_shipdate").alias("year"),
        F.datediff("l_shipdate", "o_orderdate").alias("lag"),
        F.concat(flag, F.lit("-"), F.col("l_linenumber").cast("string")).alias("maybe"),
        tx.paste(flag, "l_linestatus", sep="_").alias("pasted")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_type, CASE WHEN p_type = 'PROMO' THEN 'offer' WHEN p_type = 'STANDARD' THEN 'plain' ELSE p_type END AS kept,
  CASE WHEN p_type = 'PROMO' THEN 'offer' WHEN p_type = 'STANDARD' THEN 'plain' END AS closed, coalesce(label, p_type) AS looked_up, count(*) AS n
  FROM part LEFT JOIN (VALUES ('PROMO', 'offer'), ('LARGE', 'big')) m(old, label) ON p_type = old GROUP BY ALL""")
def recode_values(spark, sf):
    part = v.table(spark, sf, "part").select("p_type")
    mapping = {"PROMO": "offer", "STANDARD": "plain"}
    out = part.withColumns({"kept": cols.recode("p_type", mapping),
                            "closed": cols.recode("p_type", mapping, default=None), "looked_up": F.col("p_type")})
    lookup = literal_table(spark, [("PROMO", "offer"), ("LARGE", "big")], "old string, label string")
    return count_by(cols.recode_by_table(out, "looked_up", lookup, "old", "label"), "p_type", "kept", "closed", "looked_up")


@query("""SELECT o_orderstatus, CASE WHEN flag IS NULL THEN NULL WHEN flag THEN 'a' ELSE 'b' END AS propagated, CASE WHEN flag THEN 'a' ELSE 'b' END AS plain,
  coalesce(o_orderstatus IN ('F'), FALSE) AS member, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice > 200000 END AS flag FROM orders) GROUP BY ALL""")
def conditional_values(spark, sf):
    """Null-propagating and plain conditions, null-free membership."""
    orders = v.table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") > 200000).alias("flag"))
    out = orders.withColumns({
        "propagated": nl.if_else(F.col("flag"), F.lit("a"), F.lit("b")),
        "plain": cols.case_when((F.col("flag"), "a"), default="b"), "member": nl.in_set("o_orderstatus", ["F"])})
    return count_by(out, "o_orderstatus", "propagated", "plain", "member")


@query(f"WITH {s.RAW} SELECT {', '.join(f'CAST(count({d}_d) AS BIGINT) AS {d}_d' for d in v.DRUGS.values())} FROM raw")
def map_columns(spark, sf):
    raw = v.raw_isolates(spark, sf)
    wide = cols.cols_matching(raw, "_d")
    flagged = cols.map_columns(raw, wide, lambda c: c.isNotNull().cast("int"))
    return flagged.agg(*[F.sum(c).alias(c) for c in wide])


# ---------------------------------------------------------------- order, sample, windows

@query("""SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus
  ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|7'), o_orderkey) AS r FROM orders) WHERE r <= 4""")
def sample_per_group(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return ordering.sample_per_group(orders, ["o_orderpriority", "o_orderstatus"], 4, "o_orderkey", seed=7).select(
        "o_orderpriority", "o_orderkey")


@query("SELECT o_orderpriority AS level, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, level")
def frequency_sort(spark, sf):
    return ordering.frequency_sort(collapse(
        v.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("level")), ["level"]))


@query("""SELECT o_orderstatus, n, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS rank FROM (SELECT CASE WHEN o_orderstatus IN ('F', 'O')
  THEN o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1) ORDER BY rank""")
def level_order(spark, sf):
    levels = Levels.of(("F", "O"), reference="O")
    table = with_levels(v.table(spark, sf, "orders"), "o_orderstatus", levels, "rank")
    counts = table.groupBy("o_orderstatus", F.col("rank").cast("int").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    return ordering.level_order(counts, o_orderstatus=levels)


@query("""WITH c AS (SELECT o_orderstatus AS g, o_orderpriority AS level, count(*) AS n FROM orders GROUP BY ALL)
  SELECT CASE WHEN row_number() OVER w = 1 THEN g END AS label, g, level, n, row_number() OVER w AS nr, lead(n) OVER w AS next_n,
  sum(n) OVER (PARTITION BY g) AS tot, n / sum(n) OVER (PARTITION BY g) AS share,
  sum(n) OVER (PARTITION BY g ORDER BY level ROWS UNBOUNDED PRECEDING) AS cum, n = max(n) OVER (PARTITION BY g) AS is_max
  FROM c WINDOW w AS (PARTITION BY g ORDER BY level)""")
def report_windows(spark, sf):
    """Block totals, shares, running totals, line numbers, next values, blanked labels, maxima."""
    counts = count_by(v.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("g"), F.col("o_orderpriority").alias("level")), "g", "level")
    out = windows.partition_total(counts, "n", ["g"])
    out = windows.share(out, "n", ["g"])
    out = windows.running_total(out, "n", ["g"], ["level"])
    out = windows.number_rows(out, ["g"], ["level"])
    out = windows.next_value(out, "n", ["g"], ["level"], "next_n")
    out = windows.blank_repeats(out, "g", ["g"], ["level"], "label")
    return windows.flag_maximum(out, "n", ["g"])


@query("SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type) AS n_group FROM events")
def group_size(spark, sf):
    events = v.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return windows.group_size(events, ["user_id", "event_type"], "event_id")


# ---------------------------------------------------------------- quality

@query(f"WITH {s.RAW}, typed AS (SELECT row_id, Date_prel, CASE WHEN row_id % 97 = 0 THEN Date_rec + 800 ELSE Date_rec END AS Date_rec FROM raw) "
       "SELECT row_id, CAST(year(Date_rec) AS INTEGER) - CAST(year(Date_prel) AS INTEGER) AS diff_date FROM typed "
       "WHERE year(Date_rec) - year(Date_prel) > 1 OR year(Date_rec) - year(Date_prel) < 0")
def date_incoherence(spark, sf):
    """Received before the year of sampling or more than a year after; some records have a mistyped date of reception."""
    raw = v.raw_isolates(spark, sf, drugs=False)
    typed = raw.withColumn("Date_rec", F.when(F.col("row_id") % 97 == 0, F.date_add("Date_rec", 800)).otherwise(F.col("Date_rec")))
    return quality.date_incoherence(typed, "Date_prel", "Date_rec").select("row_id", "diff_date")


@query(f"WITH {s.RAW}, " + "x AS (" + " UNION ALL ".join(
    f"SELECT '{d}_d' AS variable, {d}_d AS q FROM raw" for d in v.DRUGS.values())
    + ") SELECT variable, count(*) FILTER (q = 0) AS n_zero, count(*) FILTER (q < 3) AS n_low, count(*) FILTER (q > 45) AS n_high "
      "FROM x GROUP BY 1")
def out_of_range(spark, sf):
    raw = v.raw_isolates(spark, sf)
    return quality.out_of_range(raw, cols.cols_matching(raw, "_d"), 3, 45)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE NOT (l_quantity BETWEEN 2 AND 49) OR NOT (l_discount BETWEEN 2 AND 49)")
def rows_out_of_range(spark, sf):
    lines = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return quality.rows_out_of_range(lines, ["l_quantity", "l_discount"], 2, 49)


@query(f"WITH {s.RAW}, x AS (" + " UNION ALL ".join(
    f"SELECT '{d}_SIR' AS variable, {d}_SIR AS level FROM raw" for d in v.DRUGS.values())
    + ") SELECT variable, level, count(*) AS n FROM x GROUP BY ALL")
def value_census(spark, sf):
    raw = v.raw_isolates(spark, sf)
    return quality.value_census(raw, cols.cols_matching(raw, "_SIR"))
