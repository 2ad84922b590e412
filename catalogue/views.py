"""Isolate-like views over the order tables.

An order plays the isolate, its customer the person, its lines the drugs. The raw view has
the column layout the cleaning plan expects; missing values are planted by key arithmetic
because the tables hold none.

The functions are memoised: a DataFrame is only a plan, so queries sharing a view share its
analysed plan and not any data.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilar.functions import nulls as nl
from vigilar.plans.surveillance import Settings, analysis_table, clean_isolates, status_long
from vigilar.sources.tables import literal_table, load_table

DRUGS = {1: "CIP", 2: "AZM", 3: "CTX", 4: "CRO", 5: "CAZ10", 6: "NAL", 7: "GEN"}
STATUS = {"CIP": "CIP_SIR", "AZM": "AZM_SIR", "C3G": "C3G_SIR", "NAL": "NAL_SIR", "GEN": "GEN_SIR"}
ALL_STATUS = ("CIP_SIR", "AZM_SIR", "CTX_SIR", "CRO_SIR", "CAZ1030_SIR", "NAL_SIR", "GEN_SIR", "C3G_SIR")
YEARS = list(range(1995, 2002))
PERIODS = {"1995_1996": (1995, 1996), "1997_1998": (1997, 1998), "1999_2001": (1999, 2001)}
SETTINGS = Settings(first_year=1995, periods=PERIODS, late_start="1995-07-01")
TRAVEL = [
    ("inde", 10, "asia", "1"), ("thailande", 5, "asia", "1"), ("maroc", 4, "africa", "1"),
    ("espagne", 3, "europe", "1"), ("aucun", 50, "none", "0"), ("non precise", 7, "unknown", "1"),
    ("non renseigne", 9, "unknown", "0"), (None, 1, "unknown", None),
]
# (drug, year) thresholds: one void, one left out.
THRESHOLDS = [
    (name, year, None if (i, year) == (3, 1997) else float(15 + i + (year - 1995)))
    for i, name in DRUGS.items() for year in YEARS if (i, year) != (5, 1999)
]


@cache
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, f"{sf_dir}/{name}.parquet")


@cache
def breakpoints(spark: SparkSession) -> DataFrame:
    return literal_table(spark, THRESHOLDS, "ATB string, annee int, seuil double")


@cache
def travel(spark: SparkSession) -> DataFrame:
    return literal_table(spark, TRAVEL, "voyage string, Freq int, continent string, voyage_01 string")


@cache
def drug_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diameters and recorded calls, one row per order.

    Conditional aggregates over the seven line numbers: one exchange on the order key with
    map-side combining, and no pivot. Flags are compared as character codes, which keeps the
    aggregation hash based.
    """
    lines = table(spark, sf_dir, "lineitem")
    cells = []
    for i, d in DRUGS.items():
        mine = F.col("l_linenumber") == i
        cells += [F.max(F.when(mine, F.col("l_quantity"))).alias(f"q_{d}"),
                  F.max(F.when(mine, F.ascii("l_returnflag"))).alias(f"f_{d}")]
    agg = lines.groupBy("l_orderkey").agg(*cells)
    recorded = {
        d: F.when(F.col(f"f_{d}") == 82, "R").when(F.col(f"f_{d}") == 65, "S")
            .when(F.col(f"f_{d}") == 78, "i" if i % 2 else "s*")
        for i, d in DRUGS.items()}
    return agg.select(
        "l_orderkey", *[(F.col(f"q_{d}") - 1).alias(f"{d}_d") for d in DRUGS.values()],
        *[c.alias(f"{d}_SIR") for d, c in recorded.items()])


def _void_every(c, key: str, n: int):
    return F.when(F.col(key) % n != 0, c)


@cache
def raw_isolates(spark: SparkSession, sf_dir: str, drugs: bool = True) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    base = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    if drugs:
        base = base.join(drug_lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    day, key, cust = F.to_date("o_orderdate"), F.col("o_orderkey"), F.col("c_custkey")
    priority, pick = F.col("o_orderpriority"), cust % 10
    received = F.date_add(day, (key % 30 - 2).cast("int"))
    born = F.date_sub(day, (cust * 37 % 30000 - 200).cast("int"))
    def pick_from(index, *values):
        return F.get(F.array(*[F.lit(x).cast("string") for x in values]), index.cast("int"))

    fourth = pick_from(key % 3, "Shigella Rough", "Shigella boydii", "non agglutinable")
    level = F.substring(priority, 1, 1).cast("int")
    species = F.when(level == 4, fourth).otherwise(pick_from(
        level - 1, "Shigella sonnei", "Shigella flexneri 2a", "Shigella dysenteriae", None, "Shigella flexneri"))
    free = (F.when(key % 29 == 0, "97-10607").when(key % 31 == 0, "type 1c").when(key % 37 == 0, "Ewing")
            .otherwise("Shigella sonnei g"))
    serotype = pick_from(key % 5, "1b", "2a", "3a", "4c")
    sex = nl.lookup("o_orderstatus", {"F": "F", "O": "M", "P": "I"})
    origin = nl.lookup("c_mktsegment", {"BUILDING": "Selles", "AUTOMOBILE": "Sang", "FURNITURE": "Biopsie rectale",
                                        "HOUSEHOLD": "Autre"})
    kind = pick_from(F.col("n_nationkey") % 6, "CHU ", "Institut ", "Labo ", "Clinique hospitaliere ", "LIP ")
    lab = F.concat(kind, "n_name")
    trip = pick_from(pick, "Inde (Goa)", "Pas de voyage", "Maroc", "Espagne", "Non precise", "Non renseigné",
                     "Thailande", "pas de voyage", "pas de voyage")
    mainland = F.col("r_name") == "EUROPE"
    department = pick_from(key % 4, "96", "978", "75")
    out = base.select(
        key.cast("string").alias("num_CNR"), key.alias("row_id"), cust.alias("person"),
        _void_every(day, "o_orderkey", 17).alias("Date_prel"),
        _void_every(received, "o_orderkey", 19).alias("Date_rec"),
        _void_every(born, "c_custkey", 23).alias("DN"),
        _void_every(F.year("o_orderdate"), "o_orderkey", 101).alias("year"),
        _void_every(species, "o_orderkey", 41).alias("espece"), free.alias("Resultats"),
        serotype.alias("serotype"), sex.alias("sexe"), mainland.alias("metrop"),
        origin.alias("origine_prel"), lab.alias("labo"), trip.alias("voyage"),
        department.alias("departement"),
        F.when(key % 7 == 0, F.lpad((cust * 7 % 95000).cast("string"), 5, "0")).alias("CP_patient"),
        F.lpad((cust * 11 % 98000).cast("string"), 5, "0").alias("CP_labo"),
        *([f"{d}_d" for d in DRUGS.values()] + [f"{d}_SIR" for d in DRUGS.values()] if drugs else []))
    return out


@cache
def cleaned(spark: SparkSession, sf_dir: str, drugs: bool = True) -> DataFrame:
    return clean_isolates(raw_isolates(spark, sf_dir, drugs), breakpoints(spark), settings=SETTINGS)


@cache
def isolates(spark: SparkSession, sf_dir: str, drugs: bool = True) -> DataFrame:
    """The analysis table. Without drugs the order lines are not read."""
    return analysis_table(cleaned(spark, sf_dir, drugs), travel(spark), SETTINGS)


@cache
def long_isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_long(isolates(spark, sf_dir), "row_id")


@cache
def results_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long diameters and recorded calls: (row_id, year, ATB, diam, SIR)."""
    raw = raw_isolates(spark, sf_dir)
    packed = F.array(*[
        F.struct(F.lit(d).alias("ATB"), F.col(f"{d}_d").alias("diam"), F.col(f"{d}_SIR").alias("SIR"))
        for d in DRUGS.values()])
    return raw.select("row_id", "year", F.inline(packed))


@cache
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 0/1 outcomes; categorical covariates lang, source and length class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    size = F.when(F.col("n_chars") > 500, "long").otherwise("short")
    return docs.join(labels, "doc_id").withColumn("size", size)
