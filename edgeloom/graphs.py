"""Graphs derived from the test tables, as raw(line_no, src, dst), and the same as SQL. Sides of bipartite graphs have even and odd names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ranks import with_rank

#: name -> (table, source, target, order); the orders are unique, since vertex ids depend on them.
BIPARTITE = {
    "part_supp": ("lineitem", "2 * l_partkey", "2 * l_suppkey + 1", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
    "order_part": ("lineitem", "2 * l_orderkey", "2 * l_partkey + 1", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
    "cust_nation": ("customer", "2 * c_custkey", "2 * c_nationkey + 1", ("c_custkey",)),
}
NAMES = (*BIPARTITE, "user_chain")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "user_chain":
        events = with_rank(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id"), ["ts", "event_id"], "i")
        after = events.select((F.col("i") - 1).alias("i"), F.col("user_id").alias("dst"))
        return events.join(after, "i").select((F.col("i") + 1).alias("line_no"), F.col("user_id").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    table, src, dst, order = BIPARTITE[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*order, F.expr(src).cast("long").alias("src"), F.expr(dst).cast("long").alias("dst"))
    return with_rank(rows, list(order), "r").select((F.col("r") + 1).alias("line_no"), "src", "dst")


def raw_sql(name: str) -> str:
    if name == "user_chain":
        return """SELECT i AS ln, src, dst FROM (SELECT row_number() OVER (ORDER BY ts, event_id) AS i, CAST(user_id AS BIGINT) AS src,
          CAST(lead(user_id) OVER (ORDER BY ts, event_id) AS BIGINT) AS dst FROM events) WHERE dst IS NOT NULL"""
    table, src, dst, order = BIPARTITE[name]
    return f"SELECT row_number() OVER (ORDER BY {', '.join(order)}) AS ln, CAST({src} AS BIGINT) AS src, CAST({dst} AS BIGINT) AS dst FROM {table}"
