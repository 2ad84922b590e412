"""Queries that go through written files: exports read back, partitioned snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilar.operators.aggregate import collapse
from vigilar.sources.tables import export_decimal_comma, export_tsv, new_folder, read_decimal_comma, read_tsv, stage

from . import views as v
from . import views_sql as s
from .registry import query


@query("SELECT l_orderkey, l_linenumber, nullif(l_quantity, 1) AS diam, l_extendedprice, CASE l_returnflag WHEN 'R' THEN 'R' WHEN 'A' THEN 'S' END AS recorded, "
       "CAST(l_shipdate AS DATE) AS shipped FROM lineitem")
def tsv_round_trip(spark, sf):
    """All lines exported as tab-separated text with empty fields for nulls, and read back typed."""
    flag = F.col("l_returnflag")
    rows = v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(1.0)).alias("diam"), "l_extendedprice",
        F.when(flag == "R", "R").when(flag == "A", "S").alias("recorded"), F.to_date("l_shipdate").alias("shipped"))
    path = new_folder(spark, "export-tsv")
    export_tsv(rows, path)
    return read_tsv(spark, path, rows.schema)


@query("SELECT doc_id, text, lang, source FROM documents")
def tsv_texts_round_trip(spark, sf):
    """Whole texts with quotes, tabs and line ends, exported and read back."""
    rows = v.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    path = new_folder(spark, "export-texts")
    export_tsv(rows, path)
    return read_tsv(spark, path, rows.schema, line_breaks=True)


@query("SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id, "
       "CASE WHEN event_id % 3 <> 0 THEN props END AS props FROM events")
def decimal_comma_round_trip(spark, sf):
    """All events exported as semicolon-separated text with decimal commas and NA, and read back typed."""
    key = F.col("event_id")
    rows = v.table(spark, sf, "events").select(
        "event_id", "event_type", F.when(key % 7 != 0, F.col("value")).alias("value"), F.when(key % 5 != 0, F.col("user_id")).alias("user_id"),
        F.when(key % 3 != 0, F.col("props")).alias("props"))
    path = new_folder(spark, "export-decimal-comma")
    export_decimal_comma(rows, path)
    return read_decimal_comma(spark, path, rows.schema)


_SNAPSHOT = "row_id, year_real, espece3, metrop, CIP_SIR, AZM_SIR, C3G_SIR, age"


@query(f"WITH {s.ANALYSIS} SELECT {_SNAPSHOT} FROM iso")
def staged_snapshot(spark, sf):
    """The analysis table written once, partitioned by year, and read back."""
    table = v.isolates(spark, sf).select(*_SNAPSHOT.split(", "))
    return stage(table, new_folder(spark, "snapshot")).select(*table.columns)


@query(f"WITH {s.ANALYSIS} SELECT espece3, count(*) AS n FROM iso WHERE year_real = 1997 GROUP BY espece3")
def staged_year(spark, sf):
    """One year of the snapshot: only its partition is read."""
    table = v.isolates(spark, sf, drugs=False).select("row_id", "year_real", "espece3")
    return collapse(stage(table, new_folder(spark, "snapshot-year")).where("year_real = 1997"), ["espece3"])
