"""One owner among the buckets that hold a vertex."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS, FACTOR = (1 << 31) - 1, 739_982_445


def owner_hash(vid: Column, bucket: Column, seed: int) -> Column:
    """A number below MODULUS that both ends of a membership scramble; all products stay within 64 bits."""
    stir = lambda x: (x.bitwiseXOR(F.shiftright(x, 15)) * FACTOR) % MODULUS
    return stir((stir(vid % MODULUS) + (bucket + 1) * 1_000_003 + seed * 7919) % MODULUS)


def hash_masters(members: DataFrame, seed: int) -> DataFrame:
    """(vid, bucket): the bucket whose hash with the vertex is least. Even in expectation, and one aggregation at any size."""
    least = F.min(F.struct(owner_hash(F.col("vid"), F.col("bucket").cast("long"), seed).alias("h"), "bucket")).alias("x")
    return members.groupBy("vid").agg(least).select("vid", F.col("x.bucket").alias("bucket"))


def quota_masters(members: DataFrame, p: int, n_vertices: int, seed: int) -> DataFrame:
    """(vid, bucket) by weighted draws: a bucket is drawn by its open quota and owns its first vertex without an owner.

    The draws depend on each other, so one task holds (bucket, vid); hash_masters() is for graphs that don't fit.
    """

    def run(t: pa.Table) -> pa.Table:
        bucket, vid = t["bucket"].to_numpy(), t["vid"].to_numpy()
        order = np.lexsort((vid, bucket))
        queues = [vid[order][bucket[order] == b].tolist() for b in range(p)]
        at, owner, rng = [0] * p, {}, np.random.default_rng(seed)
        quota = np.full(p, float(n_vertices))
        total = len(set(vid.tolist()))
        while len(owner) < total:
            b = int(rng.choice(p, p=quota / quota.sum()))
            q = queues[b]
            while at[b] < len(q) and q[at[b]] in owner:
                at[b] += 1
            if at[b] == len(q):
                quota[b] = 0  # nothing is left for it to own
                continue
            owner[q[at[b]]] = b
            quota[b] -= 1
        return pa.table({"vid": pa.array(list(owner), pa.int64()), "bucket": pa.array(list(owner.values()), pa.int32())})

    return members.select("bucket", "vid").groupBy().applyInArrow(run, "vid long, bucket int")


def master_balance(masters: DataFrame, p: int, n_vertices: int) -> DataFrame:
    """One row: the largest number of masters of a bucket over the mean."""
    return masters.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.round(F.max("n") / (n_vertices / p), 6).alias("master_balance"))
