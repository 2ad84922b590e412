"""Joins. None forces a broadcast of a table of unknown size: lookups are left to the
optimizer, which broadcasts below its size threshold (from file statistics, or from the
real size at run time) and falls back to a shuffled join above it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 5_000_000


def one_row_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table itself, with a run-time error when a key occurs twice."""
    others = [c for c in df.columns if c not in keys]
    checked = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in others]
    )
    unique = F.assert_true(F.col("__n") == 1, F.lit(f"lookup key {list(keys)} is not unique"))
    return checked.where(unique.isNull()).drop("__n").select(*df.columns)


def apply_corrections(df: DataFrame, fixes: DataFrame, key: str, cols: Sequence[str],
                      check: bool = True) -> DataFrame:
    """A corrected value wins over the original; column order is kept."""
    fixes = fixes.select(key, *cols)
    if check:
        fixes = one_row_per_key(fixes, [key])
    fixes = fixes.withColumnsRenamed({c: f"__fix_{c}" for c in cols}).withColumnRenamed(key, "__key")
    return (
        df.join(fixes, F.col(key) == F.col("__key"), "left")
        .withColumns({c: F.coalesce(F.col(f"__fix_{c}"), F.col(c)) for c in cols})
        .select(*df.columns)
    )


def null_safe_on(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def enrich(df: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None,
           drop: Sequence[str] = ()) -> DataFrame:
    """Add the attributes of a lookup table; a null key meets a null key."""
    dim = dim.drop(*drop).withColumnRenamed(dim_key or key, "__key")
    clash = set(df.columns) & set(dim.columns)
    if clash:
        raise ValueError(f"both tables hold {sorted(clash)}; drop one side")
    return df.join(dim, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def keep_all_groups(hits: DataFrame, groups: DataFrame, keys: Sequence[str],
                    counts: Sequence[str]) -> DataFrame:
    """Groups without any hit survive with a count of 0 (null keys match null keys)."""
    hits = hits.select(*keys, *counts).withColumnsRenamed({k: f"__{k}" for k in keys})
    return (
        hits.join(groups, null_safe_on([f"__{k}" for k in keys], keys), "right")
        .drop(*[f"__{k}" for k in keys])
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    )


def full_merge(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer merge on null-safe keys; a key of either side is kept."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    joined = left.join(renamed, null_safe_on(keys, [f"__{k}" for k in keys]), "full")
    return joined.withColumns({k: F.coalesce(F.col(k), F.col(f"__{k}")) for k in keys}).drop(
        *[f"__{k}" for k in keys]
    )


def stack_side_by_side(template: DataFrame, tables: Sequence[DataFrame],
                       keys: Sequence[str]) -> DataFrame:
    """Left-join report tables onto a template of rows. All sides are aggregated results."""
    def attach(out: DataFrame, table: DataFrame) -> DataFrame:
        on = [k for k in keys if k in table.columns]
        table = table.withColumnsRenamed({k: f"__{k}" for k in on})
        return out.join(table, null_safe_on(on, [f"__{k}" for k in on]), "left").drop(
            *[f"__{k}" for k in on]
        )
    return reduce(attach, tables, template)


def semi_by(df: DataFrame, members: DataFrame, key: str, member_key: str | None = None) -> DataFrame:
    """Rows whose key occurs in the other table."""
    members = members.select(F.col(member_key or key).alias("__key"))
    return df.join(members, F.col(key) == F.col("__key"), "left_semi")


def attach_by_key(df: DataFrame, stats: DataFrame, keys: Sequence[str], n_col: str, row_id: str,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left-join per-key statistics back onto the rows, safe for hot keys and null keys.

    ``stats`` holds one row per key and the key's row count in ``n_col``. A key with over
    ``hot_rows`` rows is spread over count / hot_rows join partitions by a hash of ``row_id``,
    so no partition grows with the key. Rows with a null key never match and are spread by
    that hash alone. How the list of hot keys is joined is left to the optimizer.
    """
    parts = F.ceil(F.col(n_col) / hot_rows).cast("long")
    hot = stats.where(F.col(n_col) > hot_rows).select(
        *[F.col(k).alias(f"__hot_{k}") for k in keys], parts.alias("__parts")
    )
    on_hot = reduce(and_, [F.col(k) == F.col(f"__hot_{k}") for k in keys])
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    spread = F.xxhash64(row_id)
    salted = (
        df.join(hot, on_hot, "left")
        .withColumn("__salt", F.when(no_key, spread).otherwise(F.pmod(spread, F.coalesce("__parts", F.lit(1).cast("long")))))
        .drop("__parts", *[f"__hot_{k}" for k in keys])
    )
    copies = stats.withColumn("__salt_r", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1).cast("long")) - 1))).withColumnsRenamed(
        {k: f"__r_{k}" for k in keys}
    )
    on = reduce(and_, [F.col(k) == F.col(f"__r_{k}") for k in keys])
    return (
        salted.join(copies, on & (F.col("__salt") == F.col("__salt_r")), "left")
        .drop("__salt", "__salt_r", *[f"__r_{k}" for k in keys])
    )
