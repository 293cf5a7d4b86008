"""Tables written to the folder that all executors share, in place of lineage that a lost executor would have to replay."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; under a temporary one where that is unset, which only a local master can share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = own.get() if own.isDefined() else None
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="edgeloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/edgeloom-{uuid.uuid4().hex}"


def _table_of(path: str) -> str:
    return f"edgeloom_{path.rsplit('-', 1)[1]}"


def saved(df: DataFrame, buckets: tuple[int, str] | None = None, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: what follows never recomputes it, whichever executor is lost.

    buckets=(n, column): stored in n buckets, so that joins and groups on the column don't shuffle it again.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    writer = df.write.option("compression", codec)
    if buckets is None:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name = _table_of(path)
    writer.format("parquet").option("path", path).bucketBy(*buckets).saveAsTable(name)
    return spark.table(name)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table made by saved() that nothing reads any more, and its entry in the catalogue."""
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/edgeloom-" in f:
            spark.sql(f"DROP TABLE IF EXISTS {_table_of(f)}")
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
