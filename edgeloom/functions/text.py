"""Vertex names in text files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = 1 << 32


def lenient_id(token: Column) -> Column:
    """The number a token begins with, 0 if it begins with none, wrapped to 32 bits without sign."""
    digits = F.regexp_extract(token, r"^\s*([+-]?\d+)", 1)
    return F.coalesce(F.pmod(digits.try_cast("bigint"), F.lit(NAMES)), F.lit(0).cast("bigint"))


def strict_id(token: Column) -> Column:
    """The token as a number of 32 bits without sign; anything else raises."""
    n = F.when(token.rlike(r"^\d+$"), token.try_cast("bigint"))
    return F.when(n < NAMES, n).otherwise(F.raise_error(F.concat(F.lit("not a vertex name: "), token)).cast("bigint"))
