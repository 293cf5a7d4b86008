"""Neighbour expansion in rounds of DataFrame plans, for graphs that no task can hold.

All p - 1 buckets grow at once. A round takes, in each bucket, the boundary vertices with the fewest open edges as core, adds their
neighbours to the boundary, and gives it the open edges of core vertices. The number of vertices a round takes doubles, and a bucket whose
boundary has few open vertices gets seeds besides, half as many again each round, so there are few rounds on long and on scattered graphs
too. An edge that two buckets want goes to the lower one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PartitionConfig
from ..operators.graph import Graph
from ..operators.ranks import with_rank
from ..storage import drop, saved

#: Growth by the round of the open boundary vertices, or seeds, that a bucket has at least.
SEEDS = 1.5


def _room(capacity: int, sizes: dict[int, int]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for b, n in sizes.items():
        out = out.when(F.col("bucket") == b, F.lit(max(0, capacity - n)))
    return out


def _pick(frontier: DataFrame, take: int, room: Column) -> DataFrame:
    """The first `take` vertices of each bucket by open edges, as far as their edges have room, but one at least; the same vertex is only
    the lowest bucket's."""
    by = Window.partitionBy("bucket").orderBy("key", F.xxhash64("vid"), "vid")
    first = frontier.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= take)
    fits = first.withColumn("edges", F.sum("key").over(by.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("rank") == 1) | (F.col("edges") <= room))
    return fits.groupBy("vid").agg(F.min("bucket").alias("bucket"))


def _seeds(live: DataFrame, need: dict[int, int], usual: float, seed: int) -> DataFrame:
    """need[b] vertices with open edges for each bucket b, or as many as there are, at random; those with more than the usual last."""
    order = live.select("vid", "key", (F.col("key") > usual).alias("late"), F.xxhash64("vid", F.lit(seed)).alias("at"))
    ranked = with_rank(order, ["late", "at", "vid"], "n")
    bucket, to = F.lit(None).cast("int"), 0
    for b, n in need.items():
        bucket, to = F.when(F.col("n").between(to, to + n - 1), F.lit(b)).otherwise(bucket), to + n
    return saved(ranked.where(F.col("n") < to).select("vid", bucket.alias("bucket"), "key"))


def frontier_expansion(graph: Graph, config: PartitionConfig) -> DataFrame:
    """Every edge gets one bucket; buckets but the last reach their capacity unless edges run out, and stop there, to the edges of one
    round. Each round gives an edge at least, so it ends."""
    p, capacity = config.p, config.capacity(graph.n_edges, 1.0)
    open_edges, done = graph.edges.select("eid", "u", "v"), []
    sizes = dict.fromkeys(range(p - 1), 0)
    boundary, take, least = None, 1, 1.0
    while True:
        growing = [b for b, n in sizes.items() if n < capacity]
        if not growing:
            break
        live = open_edges.select(F.explode(F.array("u", "v")).alias("vid")).groupBy("vid").agg(F.count("*").alias("key"))
        live = saved(live)
        if live.isEmpty():
            break
        wanted = F.col("bucket").isin(growing)
        frontier = boundary.where(wanted).join(live, "vid") if boundary is not None else None
        have = {r["bucket"]: r["n"] for r in frontier.groupBy("bucket").agg(F.count("*").alias("n")).collect()} if frontier is not None else {}  # at most p rows
        # a seed has an open edge, so no bucket needs more seeds than it has room
        need = {b: n for b in growing if (n := min(int(least), capacity - sizes[b]) - have.get(b, 0)) > 0}
        if need:
            fresh = _seeds(live, need, 4 * graph.n_edges / graph.n_vertices, config.seed)
            frontier = fresh if frontier is None else frontier.select("vid", "bucket", "key").union(fresh)
        core = saved(_pick(frontier.select("vid", "bucket", "key"), take, _room(capacity, sizes)))
        c = lambda k, b: core.select(F.col("vid").alias(k), F.col("bucket").alias(b))
        reached = open_edges.join(c("u", "bu"), "u", "left").join(c("v", "bv"), "v", "left")
        given = reached.where("bu is not null or bv is not null").select("eid", "u", "v", F.least("bu", "bv").alias("bucket"))
        near = given.select("bucket", F.explode(F.array("u", "v")).alias("vid")).distinct()
        boundary_new = saved(near if boundary is None else boundary.union(near).distinct())
        both = saved(reached.select("eid", "u", "v", F.least("bu", "bv").cast("int").alias("bucket")))
        # edges between boundary vertices go along while there is room
        mine = both.where("bucket is not null")
        rest = both.where("bucket is null").select("eid", "u", "v")
        sides = lambda k: boundary_new.where(wanted).select(F.col("vid").alias(k), "bucket")
        inner = rest.join(sides("u"), "u").join(sides("v"), ["v", "bucket"]).groupBy("eid", "u", "v").agg(F.min("bucket").alias("bucket"))
        filled = dict(sizes)
        for r in mine.groupBy("bucket").agg(F.count("*").alias("n")).collect():  # at most p rows
            filled[r["bucket"]] += r["n"]
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("eid"), "eid"))
        inner = inner.withColumn("place", place).where(F.col("place") <= _room(capacity, filled))
        got = saved(mine.union(inner.select("eid", "u", "v", F.col("bucket").cast("int"))))
        counts = {r["bucket"]: r["n"] for r in got.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # at most p rows
        for b, n in counts.items():
            sizes[b] += n
        done.append(got)
        left = saved(open_edges.join(got.select("eid"), "eid", "left_anti"))
        for old in (live, both, core, *((open_edges, boundary) if boundary is not None else ())):
            drop(old)
        open_edges, boundary, take, least = left, boundary_new, min(take * 2, graph.n_vertices), least * SEEDS
    out = open_edges.select("eid", "u", "v", F.lit(p - 1).alias("bucket"))
    for d in done:
        out = out.union(d)
    return out
