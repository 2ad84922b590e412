"""Session settings the plans are written for. All are ordinary Spark SQL options."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SESSION_SETTINGS = {
    # run-time re-planning: partition coalescing, broadcast of sides found small, skew splitting
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8000 bytes of bytecode. Wide cleaning stages can
    # exceed that in one fused method; above this limit Spark generates them split instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # no stack-trace capture for every column expression while a plan is put together
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # checkpoint files go once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """What runs inside has no method that the JVM would leave interpreted for its length, whatever the session says."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name, None)
    if before is None or int(before) > int(SESSION_SETTINGS[name]):
        spark.conf.set(name, SESSION_SETTINGS[name])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
