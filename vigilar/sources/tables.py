"""Readers with explicit schemas, small literal tables, sinks and checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import nulls as nl


def _schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A short, given table as a local relation, so its exact size is known to the optimizer."""
    schema = _schema(schema)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    table = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table)


def load_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Columnar table; with a schema no file is opened to infer one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_decimal_comma(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Semicolon-separated text with decimal commas and a header line.

    Fields are read as text and cast to the given types; unreadable values become null.
    """
    schema = _schema(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.csv(path, schema=text, sep=";", header=True, enforceSchema=False,
                         nullValue="NA", escape='"')
    def typed(f: T.StructField):
        c = F.nullif(F.col(f.name), F.lit(""))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return nl.number(c).cast(f.dataType)
        return c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)
    return raw.select(*[typed(f).alias(f.name) for f in schema.fields])


def clean_breakpoints(raw: DataFrame, drugs: Sequence[str], voided: Sequence[str] = ()) -> DataFrame:
    """(ATB, annee, seuil): third column is the threshold, cast to a number, voided for
    drugs without a reliable reference, restricted to drugs present in the data."""
    out = raw.select(
        F.col(raw.columns[0]).cast("string").alias("ATB"),
        F.col(raw.columns[1]).try_cast("int").alias("annee"),
        nl.number(raw.columns[2]).alias("seuil"),
    )
    out = out.withColumn("seuil", F.when(~nl.in_set("ATB", voided), F.col("seuil")))
    present = literal_table(raw.sparkSession, [(d,) for d in drugs], "drug string")
    return out.join(present, F.col("ATB") == F.col("drug"), "left_semi")


def load_breakpoints(spark: SparkSession, path: str, drugs: Sequence[str],
                     voided: Sequence[str] = (), sep: str = ";") -> DataFrame:
    """Threshold table from parquet or delimited text."""
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.csv(path, sep=sep, header=True, nullValue="NA")
    return clean_breakpoints(raw, drugs, voided)


def stage(df: DataFrame, path: str, by: str | None = "year_real") -> DataFrame:
    """Write a cleaned table once and go on from the written copy.

    Rows are rebalanced by the partition column: run-time re-planning splits a busy year over
    as many tasks and files as its size needs and packs quiet years together.
    """
    if by is None:
        df.write.mode("overwrite").parquet(path)
    else:
        df.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def export_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated result with a header; nulls are empty fields, quotes inside a field are doubled."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", emptyValue="", escape='"')


def read_tsv(spark: SparkSession, path: str, schema: str | T.StructType, line_breaks: bool = False) -> DataFrame:
    """What ``export_tsv`` wrote, typed; empty fields are null. With ``line_breaks`` fields may hold line ends, and a file is
    then read by one task."""
    return spark.read.csv(path, schema=_schema(schema), sep="\t", header=True, enforceSchema=False, nullValue="", emptyValue="",
                          escape='"', multiLine=line_breaks)


def export_decimal_comma(df: DataFrame, path: str) -> None:
    """Semicolon-separated text with decimal commas and a header line; null is NA, as ``read_decimal_comma`` takes it."""
    real = (T.DoubleType, T.FloatType, T.DecimalType)
    text = [F.replace(F.col(f.name).cast("string"), F.lit("."), F.lit(",")).alias(f.name) if isinstance(f.dataType, real) else F.col(f.name)
            for f in df.schema.fields]
    df.select(*text).write.mode("overwrite").csv(path, sep=";", header=True, nullValue="NA", emptyValue="", escape='"')


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one in the warehouse, which all executors share as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/vigilar-shared"


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own for one written table."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder.

    Used before iterating over a small aggregate, so losing an executor does not send the
    iteration back to the full scan.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
