"""Streaming neighbour expansion: edges come once, in random order, in batches; only a sample of open edges is kept.

A batch is classified with the state as it was when the batch began, so the result doesn't depend on timing.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PartitionConfig
from ..operators.graph import Graph
from .kernel import Expansion

SLACK = 1.05
#: Rows of an Arrow batch that are passed on at a time.
ROWS = 1 << 16


class Streamed:
    """State over the stream: each bucket's core, boundary and size, the open degrees, the sample, the buckets given last."""

    def __init__(self, degrees: np.ndarray, n_edges: int, config: PartitionConfig):
        self.config, self.n_edges, self.degree = config, n_edges, degrees.astype(np.int64).copy()
        n = len(degrees)
        self.capacity = config.capacity(n_edges, SLACK)
        self.limit = n_edges if config.inmem else min(n_edges, n * config.sample_ratio)
        self.average, self.local_average = 2 * n_edges / n, 2 * self.limit / n
        self.core = [np.zeros(n, bool) for _ in range(config.p)]
        self.boundary = [np.zeros(n, bool) for _ in range(config.p)]
        self.size = [0] * config.p
        self.rng = np.random.default_rng(config.seed)
        self.sample: list[np.ndarray] = []  # rows (eid, u, v), put together only when a bucket grows over them
        self.waiting = 0  # rows of the sample
        self.done: list[tuple[np.ndarray, np.ndarray]] = []
        self.current = 0

    def classify(self, edges: np.ndarray) -> np.ndarray:
        """A bucket for each edge, or -1: the first below its capacity with both ends in its boundary; else the first with an end in its core
        whose other end has no more open edges than the average. The bucket that grows now isn't tried."""
        u, v, out = edges[:, 1], edges[:, 2], np.full(len(edges), -1, np.int64)
        room = [b for b in range(self.current) if self.size[b] < self.capacity]
        for b in reversed(room):
            cu, cv = self.core[b][u], self.core[b][v]
            near = (cu & (self.degree[v] <= self.average)) | (cv & (self.degree[u] <= self.average))
            out[near] = b
        for b in reversed(room):
            out[self.boundary[b][u] & self.boundary[b][v]] = b
        return out

    def give(self, edges: np.ndarray, bucket: np.ndarray) -> None:
        """Assigns edges; only now sizes, boundaries and degrees change."""
        if not len(edges):
            return
        self.done.append((edges, bucket))
        for b, n in zip(*np.unique(bucket, return_counts=True), strict=True):
            own = edges[bucket == b]
            self.size[int(b)] += int(n)
            self.boundary[int(b)][own[:, 1:].ravel()] = True
        np.subtract.at(self.degree, edges[:, 1:].ravel(), 1)

    def take(self, edges: np.ndarray) -> None:
        b = self.classify(edges)
        self.give(edges[b >= 0], b[b >= 0])
        rest = b < 0
        self.sample.append(edges if rest.all() else edges[rest])
        self.waiting += len(self.sample[-1])

    def taken(self) -> np.ndarray:
        """The sample, which is empty from then on."""
        out, end = self.sample.pop() if len(self.sample) == 1 else np.empty((self.waiting, 3), np.int64), self.waiting
        while self.sample:  # from the end, so that each part goes as soon as it is copied
            part = self.sample.pop()
            out[end - len(part) : end] = part
            end -= len(part)
        self.waiting = 0
        return out

    def fill(self) -> None:
        """Grows the current bucket over the sample, and looks where the rest of the sample belongs now."""
        b = self.current
        if self.waiting:
            sample = self.taken()
            seen = np.zeros(len(self.degree), bool)
            seen[sample[:, 1]] = seen[sample[:, 2]] = True
            names, number = np.flatnonzero(seen), np.cumsum(seen, dtype=np.int32 if len(seen) < 1 << 31 else np.int64) - 1
            e = Expansion(number[sample[:, 1]], number[sample[:, 2]], len(names))
            stop = self.capacity if self.config.inmem else len(sample) // (self.config.p - b)
            core, boundary = np.zeros(len(names), bool), self.boundary[b][names]
            e.grow(b, min(self.size[b] + stop, self.capacity) if not self.config.inmem else stop, self.capacity, self.local_average, self.rng, core, boundary, self.size[b])
            own = e.bucket >= 0
            del e
            self.core[b][names[core]] = True
            self.boundary[b][names[boundary]] = True
            self.give(sample[own], np.full(int(own.sum()), b))
            self.take(sample[~own])  # the bucket just grown isn't among those tried
        self.current += 1

    def last(self) -> None:
        """What is left of the sample goes to the last bucket, whatever its size."""
        sample = self.taken()
        self.give(sample, np.full(len(sample), self.config.p - 1))

    def drain(self, edges: np.ndarray) -> None:
        """What the first buckets don't take goes to the last."""
        b = self.classify(edges)
        self.give(edges, np.where(b < 0, self.config.p - 1, b))

    def decided(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The edges and buckets that were given since the last call."""
        out, self.done = self.done, []
        return out


def stream(degrees: np.ndarray, n_edges: int, batches, config: PartitionConfig):
    """(edges, buckets) as they are decided, for batches of rows (eid, u, v). Only the sample and the state by vertex are kept."""
    s, batches = Streamed(degrees, n_edges, config), iter(batches)
    ended = False
    for _ in range(config.p - 1):
        while not ended and s.waiting < s.limit:
            edges = next(batches, None)
            if edges is None:
                ended = True
            else:
                s.take(edges)
                yield from s.decided()
        s.fill()
        yield from s.decided()
    s.last()
    yield from s.decided()
    for edges in batches:
        s.drain(edges)
        yield from s.decided()


def run_stream(degrees: np.ndarray, n_edges: int, batches, config: PartitionConfig) -> tuple[np.ndarray, np.ndarray]:
    """(edges, buckets) of a whole stream."""
    done = list(stream(degrees, n_edges, batches, config))
    if not done:
        return np.empty((0, 3), np.int64), np.empty(0, np.int64)
    return np.concatenate([e for e, _ in done]), np.concatenate([b for _, b in done])


def streaming_expansion(graph: Graph, config: PartitionConfig) -> DataFrame:
    """One task reads the stream in the order of a hash of the edges and passes on what is decided.

    It holds a bit for each vertex, bucket, and kind of membership, the open degrees and the sample, not the edges; these come sorted in parts
    from the shuffle, after the degrees. With inmem the sample is all edges, and no bucket grows before the last has come: the task takes them
    as they are stored, sorts them and counts the degrees. streaming/ has the same over Structured Streaming, with the state in tables.
    """
    n_vertices, n_edges, size = graph.n_vertices, graph.n_edges, config.batch(graph.n_edges)
    # The first key has few ties and is a long, which Spark compares without a look at the rows: the degrees are below -2 ** 62, the edges not.
    h = F.xxhash64("eid", F.lit(config.seed))
    degrees = graph.degrees().select(F.lit(0).alias("kind"), (F.col("vid") + F.lit(-(1 << 63))).alias("k"), F.col("vid").alias("h"), F.col("vid").alias("eid"), F.col("degree").alias("u"), F.lit(0).cast("long").alias("v"))
    edges = graph.edges.select(F.lit(1).alias("kind"), F.shiftright(h, 1).alias("k"), h.alias("h"), "eid", "u", "v")

    def at_once(batches):
        """The degrees, and all edges as one batch."""
        rows, key, end = np.empty((n_edges, 3), np.int64), np.empty(n_edges, np.int64), 0
        for b in batches:
            part = slice(end, end := end + b.num_rows)
            key[part] = b.column(0).to_numpy()
            for k in range(3):
                rows[part, k] = b.column(k + 1).to_numpy()
        rows = rows[np.argsort(key)]  # a hash of one long is one to one
        return np.bincount(rows[:, 1], minlength=n_vertices) + np.bincount(rows[:, 2], minlength=n_vertices), iter([rows])

    def streamed(batches):
        """The degrees, and the edges in batches."""
        degree = np.zeros(n_vertices, np.int64)

        def edges_of():
            kept = np.empty((0, 3), np.int64)
            for b in batches:
                kind, rows = b.column(0).to_numpy(), np.stack([b.column(k).to_numpy() for k in (1, 2, 3)], 1)
                degree[rows[kind == 0, 0]] = rows[kind == 0, 1]
                kept = np.r_[kept, rows[kind == 1]]
                whole = len(kept) // size * size
                yield from (kept[i : i + size] for i in range(0, whole, size))
                kept = kept[whole:]
            if len(kept):
                yield kept

        given = edges_of()
        first = next(given)  # by then all degrees have come
        return degree, itertools.chain([first], given)

    def run(batches):
        batches = filter(lambda b: b.num_rows, batches)
        first = next(batches, None)
        if first is None:
            return
        degree, given = (at_once if config.inmem else streamed)(itertools.chain([first], batches))
        for e, bucket in stream(degree, n_edges, given, config):
            for i in range(0, len(e), ROWS):
                rows = e[i : i + ROWS]
                yield pa.record_batch([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(bucket[i : i + ROWS].astype(np.int32))], names=["eid", "u", "v", "bucket"])

    schema = "eid long, u long, v long, bucket int"
    if config.inmem:
        return graph.edges.select(h.alias("h"), "eid", "u", "v").coalesce(1).mapInArrow(run, schema).repartition("eid")  # what follows isn't work for the one task
    return degrees.union(edges).orderBy("k", "h", "eid").select("kind", "eid", "u", "v").coalesce(1).mapInArrow(run, schema)
