"""Staging in the shared folder, table access and running totals used by several operators."""

from __future__ import annotations

import ctypes
import re
import sys
import types
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kept_by_worker(name: str) -> dict:
    """A dict that a Python worker keeps from task to task. The package itself travels with the plan and is unpickled anew for each
    task, with all of its module variables."""
    home = sys.modules.setdefault("vigilar_kept_by_worker", types.ModuleType("vigilar_kept_by_worker"))
    return vars(home).setdefault(name, {})


def give_back_memory() -> None:
    """Hands what a Python worker has freed back to the system. Workers outlive their tasks, and their allocators would keep it
    beside the executor's JVM for as long."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):  # other C libraries have no such call
        pass


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` with its scheme, as Spark resolves it; where it is unset, one in the warehouse, which
    all executors share as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/vigilar-shared"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and go on from the written copy, so lost executors cost no recomputation."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ranked(df: DataFrame, order: Sequence[str], totals: dict[str, Column], label: str) -> DataFrame:
    """Adds running totals in the order of ``order`` (each total up to and including its row).

    Rows are range-partitioned and staged; totals per range are summed up in a table with one row per range, so no
    task sees more than its range.
    """
    from pyspark.sql import Window

    pid = "__range"
    cut = staged(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).withColumn(pid, F.spark_partition_id()), label)
    sums = cut.groupBy(pid).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in totals.items()])
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(pid, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in totals])
    inside = Window.partitionBy(pid).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(base, pid)
    kept = [c for c in df.columns if c not in totals]
    return out.select(*kept, *[(F.sum(c).over(inside) + F.col(f"__b_{n}")).alias(n) for n, c in totals.items()])
