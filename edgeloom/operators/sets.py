"""Sets of vertices per bucket, in long form (bucket, vid), and their sizes by bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _of(members: DataFrame, bucket: int) -> DataFrame:
    return members.where(F.col("bucket") == bucket).select("vid")


def union(members: DataFrame, a: int, b: int) -> DataFrame:
    return members.where(F.col("bucket").isin(a, b)).select("vid").distinct()


def intersection(members: DataFrame, a: int, b: int) -> DataFrame:
    return _of(members, a).intersect(_of(members, b))


def difference(members: DataFrame, a: int, b: int) -> DataFrame:
    return _of(members, a).subtract(_of(members, b))


def complement(vertices: DataFrame, members: DataFrame, a: int) -> DataFrame:
    return vertices.select("vid").join(_of(members, a), "vid", "left_anti")


def set_size(members: DataFrame) -> DataFrame:
    """(bucket, n): exact distinct counts by one bitmap for each bucket and 32,768 ids."""
    slots = members.groupBy("bucket", F.bitmap_bucket_number("vid").alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("vid")).alias("bits"))
    return slots.groupBy("bucket").agg(F.sum(F.bitmap_count("bits")).alias("n"))
