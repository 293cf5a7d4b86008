"""Sorted and random orders of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import with_rank


def external_sort(keys: DataFrame, column: str) -> DataFrame:
    """Keys in order, spilled to disk where they don't fit."""
    return keys.orderBy(column)


def smallest(frontier: DataFrame) -> DataFrame:
    """The entry of frontier(vid, key) with the smallest key, ties to the smaller vertex."""
    return frontier.orderBy("key", "vid").limit(1)


def shuffled(edges: DataFrame, seed: int) -> DataFrame:
    """edges with their place in a random order that a seed fixes, so that a task that runs again gives the same."""
    return with_rank(edges.withColumn("_h", F.xxhash64("eid", F.lit(seed))), ["_h", "eid"], "place").drop("_h")
