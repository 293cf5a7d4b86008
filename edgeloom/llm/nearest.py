"""Approximate nearest neighbours: few stable projections in a kd-tree; projected neighbours are verified until a chi-square test holds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import pack, saved, table, unpack

K, EVERY = 10, 100
#: Projections (an even number), and the chance with which the farthest true neighbour is still found when a search stops.
PROJECTIONS, CONFIDENCE = 32, 0.85
#: Vectors of a shard and queries of a block, which bound what one task holds; points of a leaf; queries that are worked on together.
SHARD, BLOCK, LEAF, TOGETHER = 16_384, 4096, 256, 256
#: Vectors that the cells are fitted on, those with the smallest hashes of their ids, and cells at most; a larger cell has several shards.
SAMPLE, CELLS = 4096, 1024
MOST_BUCKETS = 4096


def chi_square(p: float, m: int) -> float:
    """The p-quantile of the chi-square distribution of m degrees, m even."""
    above = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > 1 - p else (low, mid)
    return high


def projection(dimension: int, m: int = PROJECTIONS) -> np.ndarray:
    """Gaussian, so 2-stable: a projected squared distance is the true one times a chi-square variable of m degrees.

    The projections are made orthogonal, which keeps the mean and narrows the spread, so that the chi-square quantile is on the safe side.
    With fewer dimensions than projections there are as many as dimensions, and nothing is lost.
    """
    gauss = np.random.default_rng(20_140).standard_normal((dimension, m))
    return np.linalg.qr(gauss)[0] * math.sqrt(dimension)


def split(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and starts of a kd-tree's leaves of at most so many points: median splits of the widest side. Equal points are never split."""
    order, starts, wait = np.arange(len(points)), [], [(0, len(points))]
    while wait:
        a, z = wait.pop()
        own = points[order[a:z]]
        wide = np.ptp(own, axis=0) if z > a else np.zeros(1)
        if z - a <= most or not wide.any():
            starts.append(a)
            continue
        mid = (z - a) // 2
        order[a:z] = order[a:z][np.argpartition(own[:, int(wide.argmax())], mid)]
        wait += [(a + mid, z), (a, a + mid)]
    return order, np.array(starts, np.int64)


class Cells:
    """The upper levels of the kd-tree: a median split of the widest side at each node, until there are so many cells."""

    def __init__(self, points: np.ndarray, cells: int):
        self.side, self.cut, self.cells = np.zeros(max(1, cells), np.int64), np.zeros(max(1, cells)), cells
        own = {1: points}
        for node in range(1, cells):
            x = own.pop(node)
            if len(x):
                self.side[node] = int(np.ptp(x, axis=0).argmax())
                self.cut[node] = np.median(x[:, self.side[node]])
            below = x[:, self.side[node]] < self.cut[node]
            own[2 * node], own[2 * node + 1] = x[below], x[~below]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        while node.size and node[0] < self.cells:  # all leaves are equally deep
            node = 2 * node + (points[np.arange(len(points)), self.side[node]] >= self.cut[node])
        return node - self.cells


class Index:
    """The vectors of a shard in the order of the leaves of their kd-tree, with the leaves' boxes."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray, p: np.ndarray):
        self.vectors, self.ids, self.starts, self.low, self.high, self.p = vectors, ids, starts, low, high, p
        self.points = vectors @ p
        self.norms = (self.points**2).sum(1)

    @staticmethod
    def build(vectors: np.ndarray, ids: np.ndarray, p: np.ndarray) -> Index:
        points = vectors @ p
        order, starts = split(points, LEAF)
        points = points[order]
        return Index(vectors[order], ids[order], starts, np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts), p)

    def dump(self) -> bytes:
        return pack(np.array([*self.vectors.shape, self.p.shape[1]], np.int64), self.vectors.ravel(), self.ids, self.starts, self.low.ravel(), self.high.ravel())

    @staticmethod
    def load(blob: bytes) -> Index:
        shape, vectors, ids, starts, low, high = unpack(blob)
        n, d, m = shape.tolist()
        return Index(vectors.reshape(n, d), ids, starts, low.reshape(-1, m), high.reshape(-1, m), projection(d))

    def search(self, own: np.ndarray, targets: np.ndarray, bound: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, score, vec_id) of the k nearest found for each query, and how many candidates were measured.

        bound: k candidates at least are known to be as near. Leaves whose boxes are out of reach are left out; of the others the points come
        in the order of their projected distance, first the nearest, then in growing steps, and are measured exactly. A query stops at the
        point whose projected distance squared exceeds the k-th distance squared so far times the quantile: what lies behind would have had
        to be projected farther off than all but a share of 1 - CONFIDENCE of such neighbours.
        """
        q = targets @ self.p
        gap = np.maximum(np.maximum(self.low - q[:, None], q[:, None] - self.high), 0)
        reach = limit * bound**2
        open_ = np.repeat((gap**2).sum(2) <= reach[:, None], np.diff(np.r_[self.starts, len(self.ids)]), axis=1)
        far = np.maximum(self.norms + (q**2).sum(1)[:, None] - 2 * q @ self.points.T, 0)
        far[~open_ | (self.ids == own[:, None])] = np.inf
        found, measured = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)), 0
        first = min(4 * k, far.shape[1])
        nearest = np.zeros(far.shape, bool)
        np.put_along_axis(nearest, np.argpartition(far, first - 1, axis=1)[:, :first], True, axis=1)
        for step in (None, 0.6, 0.8, 1.0):
            row, at = np.nonzero((nearest if step is None else far <= (step * reach)[:, None]) & np.isfinite(far))
            far[row, at] = np.inf
            score = np.empty(len(row))
            for i in range(0, len(row), 1 << 15):
                e = self.vectors[at[i : i + (1 << 15)]] - targets[row[i : i + (1 << 15)]]
                score[i : i + (1 << 15)] = np.sqrt((e * e).cumsum(1)[:, -1])  # added up in the order of components
            measured += len(row)
            row, score, vec = np.r_[found[0], row], np.r_[found[1], score], np.r_[found[2], self.ids[at]]
            order = np.lexsort((vec, score, row))
            row, score, vec = row[order], score[order], vec[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            found = (row[rank < k], score[rank < k], vec[rank < k])
            full = rank == k - 1
            reach[row[full]] = np.minimum(reach[row[full]], limit * score[full] ** 2)
        return *found, measured


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows with an id and a vector without null or non-finite components, not zero."""
    v = F.col("v")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)), F.lit(False)) & F.exists(v, lambda x: x != 0))


def _matrix(v: pa.ChunkedArray | pa.Array) -> np.ndarray:
    own = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return own.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest found by Euclidean distance, ties to the smaller vec_id.

    vectors(vec_id, embedding), queries(vec_id, embedding) of the same kind; a query's candidates are all vectors of its dimension but those
    of its own id. Vectors that usable() leaves out take no part on either side. Of equal vectors only the k + 1 smallest ids are indexed,
    which is all that any answer can name; rows that repeat an id and its vector are one. With fewer candidates than k all come; an empty
    table gives an empty result.
    """
    alike = Window.partitionBy("v").orderBy("vec_id")
    indexed = saved(usable(vectors).withColumn("n", F.dense_rank().over(alike)).where(F.col("n") <= k + 1).select("vec_id", "v").distinct())
    asked = saved(usable(queries).distinct())
    out = None
    for r in indexed.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():  # a row for each dimension
        own = F.size("v") == r["d"]
        found = _search(indexed.where(own), asked.where(own), r["d"], r["n"], k, chi_square(confidence, PROJECTIONS))
        out = found if out is None else out.union(found)
    if out is None:
        out = asked.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(indexed: DataFrame, asked: DataFrame, d: int, n: int, k: int, limit: float) -> DataFrame:
    """(query_id, vec_id, score), k rows or more a query, of vectors of dimension d.

    Vectors are dealt over the cells of a kd-tree's upper levels and, where a cell has more than a shard holds, over shards at random; each
    shard's tree is built once and stored. A query first searches one shard of its own cell. With the k-th distance found there it then
    visits the shards of the cells whose boxes are within reach; where many queries visit a shard, blocks of them do.
    """
    p = projection(d)
    cells = 1
    while 2 * cells * SHARD <= n and cells < CELLS:
        cells *= 2
    salts = -(-n // (cells * SHARD))
    some = indexed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect() if cells > 1 else []  # SAMPLE rows at most
    upper = Cells(np.array([r["v"] for r in some], float).reshape(-1, d) @ p, cells)

    def locate(batches):
        for b in batches:
            cell = upper.of(_matrix(b.column(1)) @ p) if b.num_rows else np.empty(0, np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cell, pa.int64())], names=["vec_id", "v", "cell"])

    located = lambda df: df.mapInArrow(locate, "vec_id long, v array<double>, cell long")
    shard = (F.col("cell") * salts + F.pmod(F.xxhash64("vec_id"), F.lit(salts))).alias("shard")

    def build(t: pa.Table) -> pa.Table:
        i = Index.build(_matrix(t["v"]), t["vec_id"].to_numpy(), p)
        low, high = ([x.tolist()] for x in (i.low.min(0), i.high.max(0)))
        return pa.table({"shard": t["shard"][:1], "low": pa.array(low, pa.list_(pa.float64())), "high": pa.array(high, pa.list_(pa.float64())), "tree": pa.array([i.dump()], pa.binary())})

    trees = saved(located(indexed).select("vec_id", "v", shard).groupBy("shard").applyInArrow(build, "shard long, low array<double>, high array<double>, tree binary"), (min(cells * salts, MOST_BUCKETS), "shard"))
    here = located(asked).select("vec_id", "v", F.lit(math.inf).alias("bound"), shard)
    found = saved(_visit(trees, here, k, limit))
    if cells * salts == 1:
        return found
    cell = F.floor(F.col("shard") / salts)
    corner = lambda c, least: trees.select(cell.alias("cell"), F.posexplode(c).alias("k", "x")).groupBy("cell", "k").agg((F.min if least else F.max)("x").alias("x")).collect()
    boxes = np.full((2, cells, p.shape[1]), np.inf)  # a cell without vectors stays out of reach
    for side, rows in enumerate((corner("low", True), corner("high", False))):  # CELLS * PROJECTIONS rows at most
        for r in rows:
            boxes[side, r["cell"], r["k"]] = r["x"]

    def route(batches):
        for b in batches:
            v, bound, own = _matrix(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy()
            q = (v @ p)[:, None]
            far = (np.maximum(np.maximum(boxes[0] - q, q - boxes[1]), 0) ** 2).sum(2) if b.num_rows else np.zeros((0, cells))
            row, cell = np.nonzero(np.where(np.isfinite(boxes[0]).all(1), far <= limit * bound[:, None] ** 2, False))
            row, there = np.repeat(row, salts), (cell[:, None] * salts + np.arange(salts)).ravel()
            row, there = row[there != own[row]], there[there != own[row]]
            yield pa.record_batch([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row)), pa.array(there, pa.int64())], names=["vec_id", "v", "bound", "shard"])

    kth = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.max("score")).otherwise(math.inf).alias("bound"))
    far = here.drop("bound").join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("bound", F.lit(math.inf)).alias("bound"), "shard")
    return found.union(_visit(trees, saved(far.mapInArrow(route, "vec_id long, v array<double>, bound double, shard long")), k, limit))


def _visit(trees: DataFrame, visits: DataFrame, k: int, limit: float) -> DataFrame:
    """(query_id, vec_id, score): for visits(vec_id, v, bound, shard) the k nearest found in the shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = []
        if left.num_rows and right.num_rows:
            i, own, v, bound = Index.load(left["tree"][0].as_py()), right["vec_id"].to_numpy(), _matrix(right["v"]), right["bound"].to_numpy()
            for a in range(0, len(own), TOGETHER):
                some = slice(a, a + TOGETHER)
                row, score, vec, _ = i.search(own[some], v[some], bound[some].copy(), k, limit)
                out.append((own[some][row], vec, score))
        query, vec, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else ([], [], [])
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    schema = "query_id long, vec_id long, score double"
    many = visits.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    if many.isEmpty():
        return trees.select("shard", "tree").groupBy("shard").cogroup(visits.groupBy("shard")).applyInArrow(run, schema)
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    left = trees.select("shard", "tree").join(many, "shard", "left").select("shard", "tree", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    right = visits.join(many, "shard", "left").select("vec_id", "v", "bound", F.col("shard").alias("at"), F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("of"))
    return left.groupBy("shard", "block").cogroup(right.groupBy("at", "of")).applyInArrow(run, schema)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op2_nearest_neighbours": op2_nearest_neighbours}
ORACLE_SQL = {
    "op2_nearest_neighbours": f"""
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum(list_transform(list_zip(q.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
      FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= {K}"""
}
