"""Bucket hashes. All on BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_hash(u: Column, v: Column, p: int) -> Column:
    """The same for both directions of an edge."""
    return F.least(u, v).bitwiseXOR(F.shiftleft(F.greatest(u, v), 1)) % p


def vertex_hash(v: Column, p: int) -> Column:
    return v % p


def low_degree_endpoint(u: Column, v: Column, du: Column, dv: Column) -> Column:
    """The endpoint of smaller degree; the first on ties."""
    return F.when(du <= dv, u).otherwise(v)
