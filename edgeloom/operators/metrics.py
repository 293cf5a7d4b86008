"""What a partitioning costs: sizes, mirrors, replication factor, balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replicas(assignments: DataFrame) -> DataFrame:
    """(bucket, vid): the vertices that a bucket's edges touch."""
    return assignments.select("bucket", F.explode(F.array("u", "v")).alias("vid")).distinct()


def _all_buckets(df: DataFrame, p: int, value: str) -> DataFrame:
    """Buckets without rows too, with 0."""
    every = df.sparkSession.range(p).select(F.col("id").cast("int").alias("bucket"))
    return every.join(df, "bucket", "left").select("bucket", F.coalesce(value, F.lit(0)).cast("long").alias(value))


def bucket_sizes(assignments: DataFrame, p: int) -> DataFrame:
    return _all_buckets(assignments.groupBy(F.col("bucket").cast("int").alias("bucket")).agg(F.count("*").alias("n_edges")), p, "n_edges")


def mirrors_per_bucket(assignments: DataFrame, p: int) -> DataFrame:
    return _all_buckets(replicas(assignments).groupBy(F.col("bucket").cast("int").alias("bucket")).agg(F.count("*").alias("mirrors")), p, "mirrors")


def metrics(assignments: DataFrame, p: int, n_vertices: int, method: str) -> DataFrame:
    """One row: V, E, total mirrors, replication factor, balance. The assignments are read once and shuffled once, by bucket and vertex, after
    partial sums; an edge is counted from both its ends."""
    ends = assignments.select("bucket", F.explode(F.array("u", "v")).alias("vid")).groupBy("bucket", "vid").agg(F.count("*").alias("n"))
    buckets = ends.groupBy("bucket").agg(F.sum("n").alias("ends"), F.count("*").alias("mirrors"))
    row = buckets.agg(F.expr("coalesce(sum(ends), 0) div 2").alias("num_edges"), F.expr("max(ends) div 2").alias("largest"), F.coalesce(F.sum("mirrors"), F.lit(0)).alias("total_mirrors"))
    return row.select(
        F.lit(method).alias("method"), F.lit(p).alias("p"), F.lit(n_vertices).cast("long").alias("num_vertices"), "num_edges", "total_mirrors",
        F.round(F.col("total_mirrors") / n_vertices, 6).alias("replication_factor"), F.round(F.col("largest") / (F.col("num_edges") / p), 6).alias("balance"),
    )


def validate(assignments: DataFrame, n_edges: int, p: int) -> None:
    """Every edge is in one bucket, or it raises."""
    row = assignments.agg(F.count("*").alias("n"), F.countDistinct("eid").alias("d"), F.count(F.when(F.col("bucket").between(0, p - 1), 1)).alias("ok")).first()
    if not row["n"] == row["d"] == row["ok"] == n_edges:
        raise AssertionError(f"{n_edges} edges, but {row['n']} assignments of {row['d']} edges, {row['ok']} to buckets 0 to {p - 1}")
