"""Binary edge lists, degree files and partition records.

A folder of part files holds what a single file did: each part of edges has a header of its own, and parts are read by many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import saved

#: u32 vertices, u64 edges, then (u32, u32) for each edge; native little endian.
HEADER, EDGE = 12, 8
#: Record tags, and how bytes that would break lines are written: FF as FF 01, 0A as FF 00; a record ends with 0A.
VERTEX_TAG, EDGE_TAG = 0, 1
ROWS = 1 << 16


def encode_edges(u: np.ndarray, v: np.ndarray, n_vertices: int) -> bytes:
    return np.uint32(n_vertices).tobytes() + np.uint64(len(u)).tobytes() + np.stack([u, v], 1).astype("<u4").tobytes()


def decode_edges(data: bytes) -> tuple[int, np.ndarray]:
    """(vertices, edges); raises where the size doesn't fit the header."""
    if len(data) < HEADER:
        raise ValueError("a binary edge list is shorter than its header")
    n = int(np.frombuffer(data, "<u8", 1, 4)[0])
    if len(data) != HEADER + EDGE * n:
        raise ValueError(f"a binary edge list of {n} edges has {len(data)} bytes, not {HEADER + EDGE * n}")
    return int(np.frombuffer(data, "<u4", 1)[0]), np.frombuffer(data, "<u4", 2 * n, HEADER).reshape(n, 2)


def write_binary_edges(edges: DataFrame, n_vertices: int) -> DataFrame:
    """(first, n, data): blobs of edges(eid, u, v) in the layout above, in the order of eid, as a table in the shared folder.

    The layout has no room for ids: read again, edges are numbered on from the first of their blob.
    """

    def run(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.column(0)[0].as_py()], pa.int64()), pa.array([b.num_rows], pa.int64()), pa.array([encode_edges(b.column(1).to_numpy(), b.column(2).to_numpy(), n_vertices)], pa.binary())], names=["first", "n", "data"])

    return saved(edges.repartitionByRange("eid").sortWithinPartitions("eid").select("eid", "u", "v").mapInArrow(run, "first long, n long, data binary"))


def read_binary_edges(blobs: DataFrame) -> DataFrame:
    """(eid, u, v) of blobs(first, data); eids are counted on from each blob's first."""

    def run(batches):
        for b in batches:
            for first, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, e = decode_edges(data)
                for i in range(0, len(e), ROWS):
                    own = e[i : i + ROWS].astype(np.int64)
                    yield pa.record_batch([pa.array(np.arange(first + i, first + i + len(own))), pa.array(own[:, 0]), pa.array(own[:, 1])], names=["eid", "u", "v"])

    return blobs.select("first", "data").mapInArrow(run, "eid long, u long, v long")


def read_binary_file(spark: SparkSession, path: str) -> DataFrame:
    """(eid, u, v) of binary edge list files, in the order of their paths. A file is read by one task and has less than 2 GB."""
    files = spark.read.format("binaryFile").load(path).select(F.col("content").alias("data"), "path", ((F.col("length") - HEADER) / EDGE).cast("long").alias("n"))
    names = files.select("path", "n").orderBy("path").collect()  # one row a file
    starts, at = [], 0
    for r in names:
        starts.append(F.struct(F.lit(r["path"]).alias("path"), F.lit(at).cast("long").alias("first")))
        at += r["n"]
    where = spark.range(1).select(F.inline(F.array(*starts)))
    return read_binary_edges(files.join(where, "path").select("first", "data"))


def read_degrees(spark: SparkSession, path: str) -> DataFrame:
    """(vid, degree) of headerless files of 32-bit degrees, numbered on in the order of their paths. A file has less than 2 GB."""

    def run(batches):
        for b in batches:
            for data, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d = np.frombuffer(data, "<u4").astype(np.int64)
                yield pa.record_batch([pa.array(np.arange(first, first + len(d))), pa.array(d)], names=["vid", "degree"])

    files = spark.read.format("binaryFile").load(path)
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("path", (F.col("length") / 4).cast("long").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row for each file
    return files.select("path", "content").join(F.broadcast(starts.select("path", "first")), "path").select("content", "first").mapInArrow(run, "vid long, degree long")


def escape(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x01").replace(b"\n", b"\xff\x00")


def unescape(data: bytes) -> bytes:
    return data.replace(b"\xff\x00", b"\n").replace(b"\xff\x01", b"\xff")


def partition_records(assignments: DataFrame, masters: DataFrame) -> DataFrame:
    """(record): a line of bytes for every edge and its bucket and every vertex and its master."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
            out = [escape(bytes([tag]) + np.array([u] if v is None else [u, v], "<u4").tobytes() + np.array([bucket], "<u2").tobytes()) + b"\n" for tag, u, v, bucket in rows]
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    edges = assignments.select(F.lit(EDGE_TAG).alias("tag"), "u", "v", "bucket")
    vertices = masters.select(F.lit(VERTEX_TAG).alias("tag"), F.col("vid").alias("u"), F.lit(None).cast("long").alias("v"), "bucket")
    return edges.union(vertices).mapInArrow(run, "record binary")


def write_partition_records(assignments: DataFrame, masters: DataFrame) -> DataFrame:
    return saved(partition_records(assignments, masters))


def write_partition_file(records: DataFrame, path: str) -> None:
    """record() lines as files of lines; every record is escaped, so a line feed only ends one."""
    records.select(F.expr("substring(record, 1, length(record) - 1)").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_partition_file(spark: SparkSession, path: str) -> DataFrame:
    """(tag, u, v, bucket) of files of such lines, split between lines among tasks."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return read_partition_records(lines.select(F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("record")))


def read_partition_records(records: DataFrame) -> DataFrame:
    """(tag, u, v, bucket) of records as partition_records() makes them; v is null for vertices."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.column(0).to_pylist():
                data = unescape(r[:-1])
                ids = np.frombuffer(data, "<u4", (len(data) - 3) // 4, 1).tolist()
                rows.append((data[0], ids[0], ids[1] if data[0] == EDGE_TAG else None, int(np.frombuffer(data[-2:], "<u2")[0])))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["tag", "u", "v", "bucket"])

    return records.select("record").mapInArrow(run, "tag int, u long, v long, bucket int")
