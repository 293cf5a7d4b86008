"""Shared helpers of the training-data operators: input columns, scratch tables and byte blobs."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, forget, saved  # noqa: F401

#: Whole texts of about so many bytes are held by one Python task at a time.
GROUP_BYTES = 16 << 20
#: Bits of a map of ids, as powers of two. When the largest fills up, it lets more rows pass than need be.
LEAST_BITS, MOST_BITS = 15, 28
NO_ID = -(1 << 63)
#: Partitions of a shuffle, at most.
MOST_TASKS = 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text, null as empty; every other column is left out, so none can clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def column(docs: DataFrame, name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return docs["`" + name.replace("`", "``") + "`"]


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts_for(n_bytes: int, each: int = GROUP_BYTES, least: int = 12) -> int:
    """The count grows with the input, so what one task holds does not."""
    return max(least, -(-n_bytes // each))


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Rows of a key in one partition, of as many as there are parts, so that what a task reads doesn't grow with the input."""
    return df.repartition(min(parts, MOST_TASKS), *keys)


def trim() -> None:
    """Gives freed memory of a Python worker back to the system; workers are kept for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(work):
    """A function over batches that gives freed memory back when it is through."""

    @functools.wraps(work)
    def run(batches):
        yield from work(batches)
        trim()

    return run


def lean_group(work):
    """A function of a group that gives freed memory back when it is through: idle workers keep theirs while others run beside them."""

    def through(out):
        trim()
        return out

    kinds = {1: lambda a: through(work(a)), 2: lambda a, b: through(work(a, b)), 3: lambda a, b, c: through(work(a, b, c))}  # Spark counts the arguments
    return functools.wraps(work)(kinds[work.__code__.co_argcount])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of numbers as one compressed blob; bytes of like weight stand together, which compresses better."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(f"{a.dtype.str}:{a.size}")
        body.append(a.view(np.uint8).reshape(a.size, a.itemsize).T.tobytes() if a.size and a.itemsize > 1 else a.tobytes())
    h = ",".join(head).encode()
    return zstandard.ZstdCompressor(level=level).compress(len(h).to_bytes(4, "little") + h + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:4], "little")
    at, out = 4 + n, []
    for item in data[4:at].decode().split(",") if n else []:
        kind, size = item.rsplit(":", 1)
        kind, size = np.dtype(kind), int(size)
        raw = np.frombuffer(data, np.uint8, size * kind.itemsize, at)
        out.append(raw.reshape(kind.itemsize, size).T.copy().view(kind).reshape(size) if size and kind.itemsize > 1 else raw.view(kind))
        at += raw.size
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in links(a, b): component is the smallest id that can be reached.

    Alternating large-star and small-star steps over the links; each round's links are written to the shared folder, and so is what a step
    joins them with, so that the links of one hub can be dealt over tasks.
    """
    e = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(rounds):
        both = e.union(e.select("b", "a")).toDF("n", "m")
        low = saved(both.groupBy("n").agg(F.min("m").alias("lo")).select("n", F.least("n", "lo").alias("lo")))
        large = saved(both.where("m > n").join(low, "n").select(F.col("m").alias("a"), F.col("lo").alias("b")).where("a <> b").distinct())
        least = saved(large.groupBy("a").agg(F.min("b").alias("lo")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("lo").alias("b")), F.struct(F.col("b").alias("a"), F.col("lo").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = saved(small)
        for old in (low, large, least):
            drop(old)
        same = [r for r in (x.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first() for x in (e, new))]
        drop(e)
        e = new
        if same[0] == same[1]:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def map_bits(n: int) -> int:
    """Bits of a map of up to n ids: eight for each, in bounds."""
    return 1 << min(max((8 * n - 1).bit_length(), LEAST_BITS), MOST_BITS)


def bit_of(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def id_map(rows: DataFrame, ids_of, bits: int) -> np.ndarray:
    """A map of so many bits that marks every id in rows; ids_of gives the ids of a batch. Null ids are NO_ID.

    Only the places of bits are shuffled, and added up to bitmaps on either side of the shuffle.
    """

    def places(batches):
        for b in batches:
            yield pa.record_batch([pa.array(np.unique(bit_of(ids_of(b), bits)) + 1)], names=["at"])

    out = np.zeros(bits, bool)
    found = rows.mapInArrow(places, "at long").groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    for r in found.collect():  # a row of 4 kB for each 32,768 bits
        own = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little").astype(bool)
        at = (r["part"] - 1) * len(own)
        out[at : at + len(own)] = own[: bits - at]
    return out


def marked(rows: DataFrame, bits: np.ndarray, wanted: bool = True) -> DataFrame:
    """The rows, with an id as first column, that a map marks, or the others."""
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(bits))  # 1 << MOST_BITS bits at most

    @lean
    def run(batches):
        own = shared.value
        for b in batches:
            at = bit_of(b.column(0).fill_null(NO_ID).to_numpy(), 8 * len(own))
            yield b.filter(pa.array((own[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) == wanted, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)
