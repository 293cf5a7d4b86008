"""Queries over the test tables, and the SQL of those that SQL can express or whose invariants it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graphs
from .config import PartitionConfig
from .functions import hilbert_decode, hilbert_encode
from .functions.hilbert import levels
from .operators import bucket_sizes, complement, difference, external_sort, hash_masters, intersection, metrics, mirrors_per_bucket, normalize, quota_masters, replicas, set_size, shuffled, smallest, union
from .operators.graph import Graph
from .operators.masters import FACTOR, MODULUS, master_balance
from .plans import assign
from .plans.closed import hilbert_keys
from .sources import parse_adjacency, parse_edges, partition_records, read_binary_edges, read_graph, read_partition_file, read_partition_records, write_binary_edges, write_edge_list, write_partition_file, write_partition_records
from .storage import saved, scratch
from .streaming import stream_partition

P = 10
CONFIG = PartitionConfig(p=P, seed=7)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_HEAD = """WITH RECURSIVE raw AS ({raw}),
e0 AS (SELECT * FROM raw WHERE src <> dst),
pos AS (SELECT src AS nm, 2 * ln AS p FROM e0 UNION ALL SELECT dst, 2 * ln + 1 FROM e0),
vt AS (SELECT nm, row_number() OVER (ORDER BY f) - 1 AS vid FROM (SELECT nm, min(p) AS f FROM pos GROUP BY nm)),
e AS (SELECT ln, a.vid AS u, b.vid AS v FROM e0 JOIN vt a ON src = a.nm JOIN vt b ON dst = b.nm),
dg AS (SELECT vid, count(*) AS d FROM (SELECT u AS vid FROM e UNION ALL SELECT v FROM e) GROUP BY vid),
nv AS (SELECT count(*) AS n FROM vt), ne AS (SELECT count(*) AS n FROM e)"""
_HILBERT = """,
sd AS (SELECT CAST(pow(2, ceil(log2(n))) AS BIGINT) AS n FROM nv),
h(ln, u, v, s, x, y, d) AS (
  SELECT ln, u, v, sd.n // 2, u, v, CAST(0 AS BIGINT) FROM e, sd
  UNION ALL
  SELECT ln, u, v, s // 2, CASE WHEN ry = 1 THEN x WHEN rx = 1 THEN (s - 1) - (y & (s - 1)) ELSE y END,
         CASE WHEN ry = 1 THEN y WHEN rx = 1 THEN (s - 1) - (x & (s - 1)) ELSE x END, d + s * s * xor(3 * rx, ry)
  FROM (SELECT *, CAST((CASE WHEN (x & s) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rx,
               CAST((CASE WHEN (y & s) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS ry FROM h WHERE s > 0))"""
_ASSIGN = {
    "random": f",\na AS (SELECT ln, u, v, CAST(xor(least(u, v), greatest(u, v) << 1) % {P} AS INTEGER) AS bucket FROM e)",
    "dbh": f",\na AS (SELECT ln, u, v, CAST((CASE WHEN p.d <= q.d THEN u ELSE v END) % {P} AS INTEGER) AS bucket FROM e JOIN dg p ON u = p.vid JOIN dg q ON v = q.vid)",
    "hsfc": _HILBERT + f",\na AS (SELECT ln, u, v, CAST((row_number() OVER (ORDER BY d, ln) - 1) // ((SELECT n FROM ne) // {P} + 1) AS INTEGER) AS bucket FROM h WHERE s = 0)",
}
_MIRRORS = ",\nm AS (SELECT DISTINCT bucket, vid FROM (SELECT bucket, u AS vid FROM a UNION ALL SELECT bucket, v FROM a))"
_BUCKETS = f"(SELECT CAST(range AS INTEGER) AS bucket FROM range({P}))"


def _head(graph: str, method: str = "") -> str:
    return _HEAD.format(raw=graphs.raw_sql(graph)) + (_ASSIGN[method] + _MIRRORS if method else "")


def _metrics_sql(graph: str, method: str) -> str:
    return f"""{_head(graph, method)}
SELECT '{method}' AS method, {P} AS p, (SELECT n FROM nv) AS num_vertices, (SELECT n FROM ne) AS num_edges,
  (SELECT count(*) FROM m) AS total_mirrors, round((SELECT count(*) FROM m) / CAST((SELECT n FROM nv) AS DOUBLE), 6) AS replication_factor,
  round((SELECT max(c) FROM (SELECT count(*) AS c FROM a GROUP BY bucket)) / (CAST((SELECT n FROM ne) AS DOUBLE) / {P}), 6) AS balance"""


def graph_of(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    return normalize(graphs.raw(spark, sf_dir, name))


def _add(name: str, query: Callable[[Graph], DataFrame], graph: str, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(graph_of(spark, sf_dir, graph))
    if sql:
        ORACLE_SQL[name] = sql


def _closed(method: str, then: Callable[[DataFrame, Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
    return lambda g: then(assign(method, g, CONFIG), g)


def _counts(g: Graph) -> DataFrame:
    return g.edges.agg(F.count("*").alias("num_edges")).select(F.lit(g.n_vertices).cast("long").alias("num_vertices"), "num_edges")


for _g in graphs.NAMES:
    _add(f"graph_counts_{_g}", _counts, _g, f"{_head(_g)} SELECT (SELECT n FROM nv) AS num_vertices, (SELECT n FROM ne) AS num_edges")
    for _m in _ASSIGN:
        _add(f"{_m}_metrics_{_g}", _closed(_m, lambda a, g, m=_m: metrics(a, P, g.n_vertices, m)), _g, _metrics_sql(_g, _m))

_G = "part_supp"
_add("vertex_ids", lambda g: g.vertices.select("vid", "name"), _G, f"{_head(_G)} SELECT vid, nm AS name FROM vt")
_add("degrees", lambda g: g.degrees(), _G, f"{_head(_G)} SELECT vid, d AS degree FROM dg")
_add("degree_histogram", lambda g: g.degrees().groupBy("degree").agg(F.count("*").alias("n_vertices")), "order_part", f"{_head('order_part')} SELECT d AS degree, count(*) AS n_vertices FROM dg GROUP BY d")
_add("parallel_edges", lambda g: g.edges.groupBy("u", "v").agg(F.count("*").alias("n")).where("n > 1"), "user_chain", f"{_head('user_chain')} SELECT u, v, count(*) AS n FROM e GROUP BY u, v HAVING count(*) > 1")
_add("adjacency_out", lambda g: g.adjacency("u"), _G, f"{_head(_G)} SELECT u AS vid, count(*) AS n, min(ln) AS first_eid, max(ln) AS last_eid FROM e GROUP BY u")
_add("adjacency_in", lambda g: g.adjacency("v"), _G, f"{_head(_G)} SELECT v AS vid, count(*) AS n, min(ln) AS first_eid, max(ln) AS last_eid FROM e GROUP BY v")
_add("incidence", lambda g: g.incidence().groupBy("vid").agg(F.sum(F.col("out").cast("long")).alias("n_out"), F.countDistinct("other").alias("n_neighbours")), "user_chain", f"{_head('user_chain')}, i AS (SELECT u AS vid, v AS other, 1 AS o FROM e UNION ALL SELECT v, u, 0 FROM e) SELECT vid, CAST(sum(o) AS BIGINT) AS n_out, count(DISTINCT other) AS n_neighbours FROM i GROUP BY vid")


def _self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = graphs.raw(spark, sf_dir, "user_chain")
    return raw.agg(F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("self_loops"), F.count(F.when(F.col("src") != F.col("dst"), 1)).alias("kept"))


QUERIES["self_loops_removed"] = _self_loops
ORACLE_SQL["self_loops_removed"] = f"SELECT count(*) FILTER (src = dst) AS self_loops, count(*) FILTER (src <> dst) AS kept FROM ({graphs.raw_sql('user_chain')})"

for _m in _ASSIGN:
    _add(f"{_m}_assign", _closed(_m, lambda a, g: a.groupBy("u", "v", "bucket").agg(F.count("*").alias("n"))), _G, f"{_head(_G, _m)} SELECT u, v, bucket, count(*) AS n FROM a GROUP BY u, v, bucket")
    _add(f"{_m}_bucket_sizes", _closed(_m, lambda a, g: bucket_sizes(a, P)), _G, f"{_head(_G, _m)} SELECT b.bucket, count(a.bucket) AS n_edges FROM {_BUCKETS} b LEFT JOIN a ON a.bucket = b.bucket GROUP BY b.bucket")

_add("hilbert_encode", lambda g: hilbert_keys(g).select("eid", "u", "v", "d"), "order_part", f"{_head('order_part')}{_HILBERT} SELECT ln AS eid, u, v, d FROM h WHERE s = 0")


def _decoded(g: Graph) -> DataFrame:
    k = levels(g.n_vertices)
    at = hilbert_decode(F.col("d"), k)
    return g.edges.select("eid", hilbert_encode(F.col("u"), F.col("v"), k).alias("d")).select("eid", at["x"].alias("u"), at["y"].alias("v"))


_add("hilbert_decode", _decoded, "order_part", f"{_head('order_part')} SELECT ln AS eid, u, v FROM e")
_add("external_sort", lambda g: external_sort(hilbert_keys(g).select("d"), "d"), "order_part", f"{_head('order_part')}{_HILBERT} SELECT d FROM h WHERE s = 0 ORDER BY d")
_add("shuffled_edges", lambda g: shuffled(g.edges, CONFIG.seed).groupBy("u", "v").agg(F.count("*").alias("n")), _G, f"{_head(_G)} SELECT u, v, count(*) AS n FROM e GROUP BY u, v")
_add("replicas_per_vertex", _closed("dbh", lambda a, g: replicas(a).groupBy("vid").agg(F.count("*").alias("n"))), _G, f"{_head(_G, 'dbh')} SELECT vid, count(*) AS n FROM m GROUP BY vid")
_add("mirrors_per_bucket", _closed("dbh", lambda a, g: mirrors_per_bucket(a, P)), _G, f"{_head(_G, 'dbh')} SELECT b.bucket, count(m.vid) AS mirrors FROM {_BUCKETS} b LEFT JOIN m ON m.bucket = b.bucket GROUP BY b.bucket")
_add("bucket_union", _closed("random", lambda a, g: union(saved(replicas(a)), 0, 1)), _G, f"{_head(_G, 'random')} SELECT vid FROM m WHERE bucket = 0 UNION SELECT vid FROM m WHERE bucket = 1")
_add("bucket_intersect", _closed("random", lambda a, g: intersection(saved(replicas(a)), 0, 1)), _G, f"{_head(_G, 'random')} SELECT vid FROM m WHERE bucket = 0 INTERSECT SELECT vid FROM m WHERE bucket = 1")
_add("bucket_except", _closed("random", lambda a, g: difference(saved(replicas(a)), 0, 1)), _G, f"{_head(_G, 'random')} SELECT vid FROM m WHERE bucket = 0 EXCEPT SELECT vid FROM m WHERE bucket = 1")
_add("bucket_complement", _closed("random", lambda a, g: complement(g.vertices, replicas(a), 0)), _G, f"{_head(_G, 'random')} SELECT vid FROM vt EXCEPT SELECT vid FROM m WHERE bucket = 0")
_add("bucket_set_sizes", _closed("random", lambda a, g: set_size(replicas(a))), _G, f"{_head(_G, 'random')} SELECT bucket, count(*) AS n FROM m GROUP BY bucket")


def _comparison(g: Graph) -> DataFrame:
    out = [metrics(assign(m, g, CONFIG), P, g.n_vertices, m) for m in _ASSIGN]
    return out[0].union(out[1]).union(out[2])


QUERIES["method_comparison"] = lambda spark, sf_dir: _comparison(graph_of(spark, sf_dir, "order_part"))
ORACLE_SQL["method_comparison"] = " UNION ALL ".join(f"SELECT * FROM ({_metrics_sql('order_part', m)})" for m in _ASSIGN)

# Neighbour expansion draws at random: what is compared doesn't depend on the draws.
_COVERAGE = "SELECT u, v, count(*) AS n FROM e GROUP BY u, v"
_ZEROS = "SELECT CAST(0 AS BIGINT) AS unassigned, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS beyond_bounds"


def _violations(a: DataFrame, g: Graph, slack: float, extra: int = 0, p: int = P) -> DataFrame:
    """Edges without a bucket, with two, with one that isn't there; buckets (but the last) beyond their capacity and the largest degree."""
    a = saved(a)
    most = g.degrees().agg(F.max("degree")).first()[0]
    bound = PartitionConfig(p=p).capacity(g.n_edges, slack) + max(most, extra)
    full = bucket_sizes(a, p).where(f"bucket < {p - 1}").agg(F.count(F.when(F.col("n_edges") > bound, 1)).alias("beyond_bounds"))
    row = a.agg(F.countDistinct("eid").alias("d"), F.count("*").alias("n"), F.count(F.when(~F.col("bucket").between(0, p - 1), 1)).alias("outside"))
    return row.join(F.broadcast(full)).select((g.n_edges - F.col("d")).alias("unassigned"), (F.col("n") - F.col("d")).alias("twice"), "outside", "beyond_bounds")  # one row each


def _expansion(method: str, config: PartitionConfig) -> None:
    slack = 1.05 if method == "sne" else 1.0
    name = method + "_inmem" * config.inmem
    _add(f"{name}_edge_coverage", lambda g: assign(method, g, config).groupBy("u", "v").agg(F.count("*").alias("n")), _G, f"{_head(_G)} {_COVERAGE}")
    if not config.inmem:
        _add(f"{name}_violations", lambda g: _violations(assign(method, g, config), g, slack, config.batch(g.n_edges) if method == "sne" else 0), _G, _ZEROS)
        graph = "order_part" if method == "ne" else _G
        _add(f"{name}_metrics", lambda g: _within(assign(method, g, config), g, method), graph, f"""{_head(graph)} SELECT '{method}' AS method, {P} AS p, (SELECT n FROM nv) AS num_vertices,
          (SELECT n FROM ne) AS num_edges, true AS factor_within, true AS balance_within""")


def _top(g: Graph) -> float:
    """The replication factor that no partitioning exceeds: sum of min(p, degree) / V."""
    return round(g.degrees().agg(F.sum(F.least("degree", F.lit(P))) / g.n_vertices).first()[0], 6)


def _within(a: DataFrame, g: Graph, method: str) -> DataFrame:
    """The metrics of a partitioning that is drawn at random, as far as they are the same for every draw: counts, and whether the replication
    factor is in its bounds, and the balance below 2."""
    row = metrics(saved(a), P, g.n_vertices, method)
    return row.select("method", "p", "num_vertices", "num_edges", F.col("replication_factor").between(1.0, _top(g)).alias("factor_within"), (F.col("balance") < 2).alias("balance_within"))


_expansion("ne", CONFIG)
_expansion("sne", CONFIG)
_expansion("sne", PartitionConfig(p=P, seed=CONFIG.seed, inmem=True))
_expansion("ne_frontier", CONFIG)


_STREAM = PartitionConfig(p=4, seed=CONFIG.seed, sample_ratio=4)


def _streamed(g: Graph) -> DataFrame:
    return stream_partition(g, _STREAM)


_add("sne_stream_edge_coverage", lambda g: _streamed(g).groupBy("u", "v").agg(F.count("*").alias("n")), _G, f"{_head(_G)} {_COVERAGE}")
_add("sne_stream_violations", lambda g: _violations(_streamed(g), g, 1.05, g.n_vertices * _STREAM.sample_ratio, _STREAM.p), _G, _ZEROS)


def _bounds(g: Graph) -> DataFrame:
    """For each method whether 1 <= replication factor <= sum of min(p, degree) / V."""
    rows = None
    for m in ("random", "dbh", "hsfc", "ne", "sne"):
        r = metrics(saved(assign(m, g, CONFIG)), P, g.n_vertices, m).select("method", F.col("replication_factor").between(1.0, _top(g)).alias("within"))
        rows = r if rows is None else rows.union(r)
    return rows


def replication_factors(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("part_supp", "order_part"), methods: tuple[str, ...] = ("random", "dbh", "hsfc", "ne", "sne")) -> dict[str, dict[str, float]]:
    """graph -> method -> replication factor, p = P."""
    out: dict[str, dict[str, float]] = {}
    for name in names:
        g = graph_of(spark, sf_dir, name)
        out[name] = {m: metrics(assign(m, g, CONFIG), P, g.n_vertices, m).first()["replication_factor"] for m in methods}
    return out


_add("rf_bound", _bounds, "user_chain", "SELECT method, true AS within FROM (VALUES ('random'), ('dbh'), ('hsfc'), ('ne'), ('sne')) t(method)")


def _masters(g: Graph, quota: bool) -> DataFrame:
    members = saved(replicas(assign("dbh", g, CONFIG)))
    m = quota_masters(members, P, g.n_vertices, CONFIG.seed) if quota else hash_masters(members, CONFIG.seed)
    m = saved(m.select("vid", F.col("bucket").cast("int").alias("bucket")))
    held = m.join(members, ["vid", "bucket"], "left_semi").groupBy("vid").agg(F.count("*").alias("n_masters"))
    return held


for _q, _n in ((False, "master_assignment"), (True, "master_assignment_quota")):
    _add(_n, lambda g, q=_q: _masters(g, q), _G, f"{_head(_G)} SELECT vid, CAST(1 AS BIGINT) AS n_masters FROM vt")
_STIR = f"(xor({{0}}, {{0}} >> 15) * {FACTOR}) % {MODULUS}"
_OWNERS = f""",
k AS (SELECT bucket, vid, {_STIR.format(f"(vid % {MODULUS})")} AS x FROM m),
j AS (SELECT bucket, vid, (x + (bucket + 1) * 1000003 + {CONFIG.seed * 7919}) % {MODULUS} AS x FROM k),
o AS (SELECT vid, arg_min(bucket, {{{{'h': {_STIR.format("x")}, 'b': bucket}}}}) AS bucket FROM j GROUP BY vid)""".replace("{{", "{").replace("}}", "}")
_add("hash_master", lambda g: hash_masters(replicas(assign("dbh", g, CONFIG)), CONFIG.seed), _G, f"{_head(_G, 'dbh')}{_OWNERS} SELECT vid, bucket FROM o")
_add("master_balance", lambda g: master_balance(hash_masters(replicas(assign("dbh", g, CONFIG)), CONFIG.seed), P, g.n_vertices), _G,
     f"{_head(_G, 'dbh')}{_OWNERS} SELECT round(max(n) / (CAST((SELECT n FROM nv) AS DOUBLE) / {P}), 6) AS master_balance FROM (SELECT count(*) AS n FROM o GROUP BY bucket)")


def _records(g: Graph) -> DataFrame:
    a = assign("dbh", g, CONFIG)
    back = read_partition_records(write_partition_records(a, hash_masters(replicas(a), CONFIG.seed)))
    return back.where("tag = 1").groupBy("u", "v", "bucket").agg(F.count("*").alias("n"))


_add("partition_file_roundtrip", _records, _G, f"{_head(_G, 'dbh')} SELECT u, v, bucket, count(*) AS n FROM a GROUP BY u, v, bucket")
_add("binary_edges_roundtrip", lambda g: read_binary_edges(write_binary_edges(g.edges, g.n_vertices)).groupBy("u", "v").agg(F.count("*").alias("n")), _G, f"{_head(_G)} {_COVERAGE}")


def _partition_file(g: Graph, tag: int) -> DataFrame:
    """What a file of records, written and read again, says of edges (tag 1) or vertices (tag 0)."""
    a, path = saved(assign("dbh", g, CONFIG)), scratch(g.edges.sparkSession)
    write_partition_file(partition_records(a, hash_masters(replicas(a), CONFIG.seed)), path)
    back = read_partition_file(g.edges.sparkSession, path).where(F.col("tag") == tag)
    return back.groupBy("u", "v", "bucket").agg(F.count("*").alias("n")) if tag else back.select(F.col("u").alias("vid"), "bucket")


_add("partition_file_edges", lambda g: _partition_file(g, 1), _G, f"{_head(_G, 'dbh')} SELECT u, v, bucket, count(*) AS n FROM a GROUP BY u, v, bucket")
_add("partition_file_vertices", lambda g: _partition_file(g, 0), _G, f"{_head(_G, 'dbh')}{_OWNERS} SELECT vid, bucket FROM o")
_add("smallest_degree", lambda g: smallest(g.degrees().withColumnRenamed("degree", "key")), _G, f"{_head(_G)} SELECT vid, d AS key FROM dg ORDER BY d, vid LIMIT 1")


def _text_file(spark: SparkSession, lines: DataFrame) -> str:
    """A file of the values of lines(line_no, value), in their order."""
    path = scratch(spark)
    lines.repartitionByRange(4, "line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    return path


def _counted(raw: DataFrame) -> DataFrame:
    return raw.groupBy("src", "dst").agg(F.count("*").alias("n"))


def _edge_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge list rewritten as a plain one, and read again."""
    path = scratch(spark)
    write_edge_list(graphs.raw(spark, sf_dir, "user_chain"), path)
    return _counted(read_graph(spark, path))


def _as_lines(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    return graphs.raw(spark, sf_dir, "user_chain").select("line_no", F.expr(value).alias("value"))


QUERIES["edge_list_parse"] = lambda spark, sf_dir: parse_edges(_as_lines(spark, sf_dir, "concat(src, if(line_no % 3 = 0, ',', if(line_no % 3 = 1, '\\t', '  ')), dst, ' 0.5')")).select("src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
ORACLE_SQL["edge_list_parse"] = f"SELECT src, dst, count(*) AS n FROM ({graphs.raw_sql('user_chain')}) WHERE src <> dst GROUP BY src, dst"
QUERIES["adj_list_parse"] = lambda spark, sf_dir: parse_adjacency(_as_lines(spark, sf_dir, "concat_ws(' ', src, 2, dst, src)")).groupBy("src", "dst").agg(F.count("*").alias("n"))
ORACLE_SQL["adj_list_parse"] = ORACLE_SQL["edge_list_parse"]


_PLAIN = ORACLE_SQL["edge_list_parse"]
QUERIES["edge_list_file"] = _edge_file
ORACLE_SQL["edge_list_file"] = _PLAIN
QUERIES["edge_list_file_ids"] = lambda spark, sf_dir: normalize(read_graph(spark, _text_file(spark, _as_lines(spark, sf_dir, "concat(src, ' ', dst)")))).vertices.select("vid", "name")
ORACLE_SQL["edge_list_file_ids"] = f"{_head('user_chain')} SELECT vid, nm AS name FROM vt"
QUERIES["adjacency_file"] = lambda spark, sf_dir: _counted(read_graph(spark, _text_file(spark, _as_lines(spark, sf_dir, "concat_ws('\t', src, 2, dst, src)")), "adjlist"))
ORACLE_SQL["adjacency_file"] = _PLAIN
QUERIES["comment_lines"] = lambda spark, sf_dir: _counted(parse_edges(_as_lines(spark, sf_dir, "concat(if(src % 3 = 0, '#', if(src % 3 = 1, '%', '')), src, ' ', dst)")))
ORACLE_SQL["comment_lines"] = f"SELECT src, dst, count(*) AS n FROM ({graphs.raw_sql('user_chain')}) WHERE src <> dst AND src % 3 = 2 GROUP BY src, dst"
QUERIES["lenient_names"] = lambda spark, sf_dir: _counted(parse_edges(_as_lines(spark, sf_dir, "concat(if(src % 2 = 0, 'x', if(src % 3 = 0, '-', '')), src, ' ', dst, if(dst % 2 = 0, 'y', ''))")))
ORACLE_SQL["lenient_names"] = f"""SELECT src, dst, count(*) AS n FROM (SELECT CAST(CASE WHEN src % 2 = 0 THEN 0 WHEN src % 3 = 0 THEN (4294967296 - src) % 4294967296 ELSE src END AS BIGINT) AS src, dst
  FROM ({graphs.raw_sql('user_chain')})) WHERE src <> dst GROUP BY src, dst"""
