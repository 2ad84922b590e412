"""Projection and column transforms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls as nl


def select_first(df: DataFrame, first: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Named columns first, then the rest in table order, without ``exclude``."""
    rest = [c for c in df.columns if c not in first and c not in exclude]
    return df.select(*first, *rest)



def cols_matching(df: DataFrame, part: str, suffix: bool = False) -> list[str]:
    """Column names holding ``part``, case-insensitively; ``suffix`` asks for it at the end.

    With ``suffix`` the looser substring rule must agree, so a stray name is noticed.
    """
    loose = [c for c in df.columns if part.lower() in c.lower()]
    if not suffix:
        return loose
    strict = [c for c in df.columns if c.endswith(part)]
    if strict != loose:
        raise ValueError(f"columns {sorted(set(loose) - set(strict))} hold {part!r} elsewhere")
    return strict


def map_columns(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """One expression over many columns, as one projection."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def rename(df: DataFrame, names: Mapping[str, str] | None = None,
           by_position: Mapping[int, str] | None = None) -> DataFrame:
    """Rename by name or by 1-based position."""
    mapping = dict(names or {})
    for position, new in (by_position or {}).items():
        mapping[df.columns[position - 1]] = new
    return df.withColumnsRenamed(mapping)


def safe_cast(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast by type name; a value that cannot be read becomes null."""
    return df.withColumns({
        c: nl.number(c) if t == "double" else F.col(c).try_cast(t) for c, t in types.items()
    })


def coalesce_columns(df: DataFrame, name: str, cols: Sequence[str], drop: bool = False) -> DataFrame:
    out = df.withColumn(name, F.coalesce(*[F.col(c) for c in cols]))
    return out.drop(*[c for c in cols if c != name]) if drop else out


_KEEP = object()


def recode(c: Column | str, mapping: Mapping, default=_KEEP) -> Column:
    """Value map (to non-null values). Unmatched values stay, or take ``default``; null stays null."""
    c = nl.col(c)
    found = nl.lookup(c, mapping)
    if default is None:
        return found
    other = c if default is _KEEP else F.when(c.isNotNull(), F.lit(default))
    return F.coalesce(found, other)


def recode_by_table(df: DataFrame, column: str, table: DataFrame, old: str, new: str) -> DataFrame:
    """Value map held as a table, for maps too large for an expression; unmatched stay."""
    lookup = table.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return (
        df.join(lookup, F.col(column) == F.col("__old"), "left")
        .withColumn(column, F.when(F.col("__old").isNull(), F.col(column)).otherwise(F.col("__new")))
        .drop("__old", "__new")
    )


def case_when(*branches: tuple[Column, object], default=None) -> Column:
    """SQL flavour: first true branch wins, a null condition is not true."""
    out = None
    for cond, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        out = (F if out is None else out).when(cond, value)
    if default is not None:
        out = out.otherwise(default if isinstance(default, Column) else F.lit(default))
    return out


def apart(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns as they are, worked out in a projection of their own.

    A higher-order function is not fused with the operators around it. So the joins below, the columns and the counting above
    are generated separately, and none of their methods outgrows what the JVM compiles.
    """
    first, *rest = cols
    return df.select(F.get(F.transform(F.array(first), lambda x: x), F.lit(0)).alias(first), *rest)


def fill_all(df: DataFrame, value: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Every null becomes the literal; columns are turned into text first."""
    cols = list(cols or df.columns)
    return df.withColumns({c: F.col(c).cast("string") for c in cols}).na.fill(value, subset=cols)


def conditional_void(df: DataFrame, cond: Column, cols: Sequence[str]) -> DataFrame:
    """Null several columns where the condition holds; an unknown condition leaves them."""
    return df.withColumns({c: F.when(F.coalesce(cond, F.lit(False)), None).otherwise(F.col(c))
                           for c in cols})
