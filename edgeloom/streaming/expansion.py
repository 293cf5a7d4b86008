"""Edges from a stream, classified as they come: foreachBatch over Structured Streaming.

The driver holds no edges: each micro-batch is joined with the tables of boundary and core vertices, which are stored, and its unplaced
edges are added to a stored sample. When the sample is full one task grows the next bucket over it, as its size is bounded by the setting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PartitionConfig
from ..operators.graph import Graph
from ..plans.kernel import Expansion
from ..plans.streamed import SLACK
from ..storage import drop, saved, scratch


#: Files that a graph is streamed from, at most.
MOST_FILES = 16


class StreamPartitioner:
    """degrees(vid, degree) and the number of edges must be known when the stream starts; batches are rows (eid, u, v).

    Use `stream.writeStream.foreachBatch(partitioner.batch)`, then finish() for the assignments. A batch that comes again after a failure
    is left out, by its number.
    """

    def __init__(self, degrees: DataFrame, n_vertices: int, n_edges: int, config: PartitionConfig):
        self.config, self.n_vertices = config, n_vertices
        self.capacity = config.capacity(n_edges, SLACK)
        self.limit = n_edges if config.inmem else min(n_edges, n_vertices * config.sample_ratio)
        self.average, self.local_average = 2 * n_edges / n_vertices, 2 * self.limit / n_vertices
        self.degrees, self.done, self.last = saved(degrees.select("vid", "degree")), [], -1  # open degrees, stored anew with every batch
        self.members: DataFrame | None = None  # (vid, bucket, core)
        self.sample: DataFrame | None = None
        self.waiting, self.current, self.sizes = 0, 0, dict.fromkeys(range(config.p), 0)

    def batch(self, edges: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        self.last = number
        self._take(edges.select("eid", "u", "v"))
        while self.waiting >= self.limit and self.current < self.config.p - 1:
            self._fill()

    def finish(self) -> DataFrame:
        """The assignments of all edges that came."""
        while self.waiting and self.current < self.config.p - 1:
            self._fill()
        if self.sample is not None:
            self._give(self.sample.select("eid", "u", "v", F.lit(self.config.p - 1).alias("bucket")))
            self.sample, self.waiting = None, 0
        out = self.done[0]
        for d in self.done[1:]:
            out = out.union(d)
        return out.select("eid", "u", "v", "bucket")

    def _classify(self, edges: DataFrame) -> DataFrame:
        """edges with a bucket, null where none takes them: both ends in a boundary, else an end in a core and the other end of few open edges."""
        open_buckets = [b for b in range(self.current) if self.sizes[b] < self.capacity]
        if self.members is None or not open_buckets:
            return edges.withColumn("bucket", F.lit(None).cast("int"))
        m = self.members.where(F.col("bucket").isin(open_buckets)).groupBy("vid").agg(F.collect_set("bucket").alias("near"), F.collect_set(F.when(F.col("core"), F.col("bucket"))).alias("core"))  # p values at most
        open_degree = self.degrees
        end = lambda k: m.join(open_degree, "vid").select(F.col("vid").alias(k), F.col("near").alias(f"n{k}"), F.col("core").alias(f"c{k}"), F.col("degree").alias(f"d{k}"))
        rest = open_degree.select(F.col("vid"), F.col("degree"))
        x = edges.join(end("u"), "u", "left").join(end("v"), "v", "left")
        x = x.join(rest.select(F.col("vid").alias("u"), F.col("degree").alias("eu")), "u").join(rest.select(F.col("vid").alias("v"), F.col("degree").alias("ev")), "v")
        both = F.array_min(F.array_intersect("nu", "nv"))
        few = F.array_union(F.when(F.col("ev") <= self.average, F.coalesce("cu", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>")), F.when(F.col("eu") <= self.average, F.coalesce("cv", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>")))
        return x.select("eid", "u", "v", F.coalesce(both, F.array_min(few)).cast("int").alias("bucket"))

    def _take(self, edges: DataFrame) -> None:
        placed = saved(self._classify(edges))
        self._give(placed.where("bucket is not null"))
        more = placed.where("bucket is null").select("eid", "u", "v")
        self.sample = saved(more if self.sample is None else self.sample.union(more))
        self.waiting = self.sample.count()

    def _give(self, placed: DataFrame, core: DataFrame | None = None) -> None:
        placed = placed.select("eid", "u", "v", F.col("bucket").cast("int").alias("bucket"))
        for r in placed.groupBy("bucket").count().collect():  # at most p rows
            self.sizes[r["bucket"]] += r["count"]
        near = placed.select(F.explode(F.array("u", "v")).alias("vid"), "bucket", F.lit(False).alias("core"))
        parts = [near] + ([core] if core is not None else []) + ([self.members] if self.members is not None else [])
        members = parts[0]
        for x in parts[1:]:
            members = members.union(x)
        members = saved(members.groupBy("vid", "bucket").agg(F.max("core").alias("core")))
        spent = placed.select(F.explode(F.array("u", "v")).alias("vid")).groupBy("vid").agg(F.count("*").alias("n"))
        degrees = saved(self.degrees.join(spent, "vid", "left").select("vid", (F.col("degree") - F.coalesce("n", F.lit(0))).alias("degree")))
        if self.members is not None:
            drop(self.members)
            drop(self.degrees)
        self.members, self.degrees = members, degrees
        self.done.append(placed)

    def _fill(self) -> None:
        b, config, capacity, average, start = self.current, self.config, self.capacity, self.local_average, self.sizes[self.current]

        def run(t: pa.Table) -> pa.Table:
            order = np.argsort(t["eid"].to_numpy(), kind="stable")
            eid, u, v = (t[c].to_numpy()[order] for c in ("eid", "u", "v"))
            names, ends = np.unique(np.r_[u, v], return_inverse=True)
            e = Expansion(ends[: len(u)], ends[len(u) :], len(names))
            core = np.zeros(len(names), bool)
            stop = capacity if config.inmem else min(capacity, start + len(u) // (config.p - b))
            e.grow(b, stop, capacity, average, np.random.default_rng(config.seed + b), core, np.zeros(len(names), bool), start)
            own = e.bucket >= 0
            return pa.table({"eid": eid, "u": u, "v": v, "bucket": pa.array([b if x else None for x in own.tolist()], pa.int32()), "cu": core[ends[: len(u)]], "cv": core[ends[len(u) :]]})

        grown = saved(self.sample.groupBy().applyInArrow(run, "eid long, u long, v long, bucket int, cu boolean, cv boolean"))  # the sample's size is a setting
        core = grown.select(F.explode(F.array(F.struct(F.col("u").alias("vid"), F.col("cu").alias("core")), F.struct(F.col("v").alias("vid"), F.col("cv").alias("core")))).alias("x")).where("x.core").select("x.vid", F.lit(b).alias("bucket"), "x.core").distinct()
        self._give(grown.where("bucket is not null"), core)
        rest, self.sample = grown.where("bucket is null").select("eid", "u", "v"), None
        self._take(rest)
        self.current += 1


def stream_partition(graph: Graph, config: PartitionConfig) -> DataFrame:
    """The edges of a graph as a stream of files in random order, classified batch by batch; no task holds the edges or the vertices."""
    spark = graph.edges.sparkSession
    source, checkpoint = scratch(spark), scratch(spark)
    n = graph.n_edges
    files = 1 if config.p == 1 else max(1, min(MOST_FILES, -(-n // max(1, min(n, graph.n_vertices * config.sample_ratio)))))
    graph.edges.repartition(files, F.xxhash64("eid", F.lit(config.seed))).write.parquet(source)
    s = StreamPartitioner(graph.degrees(), graph.n_vertices, n, config)
    batches = spark.readStream.schema(graph.edges.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = batches.writeStream.foreachBatch(s.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return s.finish()
