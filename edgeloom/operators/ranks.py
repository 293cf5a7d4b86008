"""Row numbers over a whole table without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import saved


def with_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with row numbers from 0 in the given order.

    Rows are dealt by ranges of the order and sorted and numbered there; the sizes of the ranges, one row each, give where each range
    starts. The numbered table is stored, as its ranges must be the same for the sizes and for the rows.
    """
    part, place = f"_{name}_part", f"_{name}_place"
    ranged = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()).sortWithinPartitions(part, *order)
    # a partition's ids rise by one from a start that the upper bits hold
    own = saved(ranged.withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = own.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row for each range
    return own.join(F.broadcast(starts), part).withColumn(name, (F.col("start") + F.col(place)).cast("long")).drop(part, place, "start")
