"""Text helpers with the semantics the cleaning rules need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col

# Accented letters and the plain letters they fold to.
ACCENTED = "àâäáãçéèêëîïíôöóõùûüúñ"
PLAIN = "aaaaaceeeeiiioooouuuun"


def replace_all(c: Column | str, pattern: str, replacement: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(col(c), ("(?i)" if ignore_case else "") + pattern, replacement)


def replace_first(c: Column | str, pattern: str, replacement: str = "") -> Column:
    """Replace the first match only."""
    return F.regexp_replace(col(c), f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def part(c: Column | str, start: int, end: int) -> Column:
    """Characters ``start`` to ``end``, both included, counted from 1."""
    return F.substring(col(c), start, end - start + 1)


def paste(*cols: Column | str, sep: str = "", missing: str = "NA") -> Column:
    """Join texts; a null becomes the literal ``missing`` instead of nulling the result."""
    return F.concat_ws(sep, *[F.coalesce(col(c).cast("string"), F.lit(missing)) for c in cols])


def fold_accents(c: Column | str) -> Column:
    return F.translate(col(c), ACCENTED, PLAIN)
