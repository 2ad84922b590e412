"""Ordered category lists, standing in for a factor type."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nulls import col


@dataclass(frozen=True)
class Levels:
    """Ordered level list; ``reference`` moves one level to the front."""

    values: tuple[str, ...]
    reference: str | None = None

    @staticmethod
    def of(values: Sequence[str], reference: str | None = None) -> "Levels":
        values = tuple(values)
        if len(set(values)) != len(values):
            raise ValueError(f"repeated level in {values}")
        if reference is not None and reference not in values:
            raise ValueError(f"reference {reference!r} is not one of {values}")
        return Levels(values, reference)

    @property
    def ordered(self) -> tuple[str, ...]:
        if self.reference is None:
            return self.values
        return (self.reference, *[v for v in self.values if v != self.reference])

    def relevel(self, reference: str) -> "Levels":
        return Levels.of(self.values, reference)

    def relabel(self, labels: Sequence[str]) -> dict[str, str]:
        """Level -> label, by position in the level order."""
        if len(labels) != len(self.values):
            raise ValueError("one label per level is needed")
        return dict(zip(self.values, labels))

    def rank(self, c: Column | str) -> Column:
        """1-based position of the value; null when it is not a level."""
        return F.nullif(
            F.array_position(F.array(*[F.lit(v) for v in self.ordered]), col(c)), F.lit(0)
        )

    def keep(self, c: Column | str) -> Column:
        """The value itself, null when it is not a level."""
        return F.when(col(c).isin(list(self.values)), col(c))


def with_levels(df: DataFrame, column: str, levels: Levels, rank: str | None = None) -> DataFrame:
    """Void values outside the level list and add their rank in level order."""
    return df.withColumns(
        {column: levels.keep(column), rank or f"{column}_rank": levels.rank(column)}
    )
