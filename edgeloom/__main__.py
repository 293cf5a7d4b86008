"""Command line: partition a graph, or rewrite it as a plain edge list.

python -m edgeloom partition --filename edges.txt --method sne --p 10 --output out
python -m edgeloom convert --filename graph.adj --filetype adjlist --output edges
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .config import METHODS, PartitionConfig
from .operators import bucket_sizes, hash_masters, metrics, normalize, replicas
from .operators.masters import master_balance
from .operators.metrics import validate
from .plans import PARTITIONERS, assign
from .session import ship
from .sources import partition_records, read_graph, write_edge_list
from .sources.text import FILE_TYPES
from .storage import saved


def partition(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Writes vertices, assignments, masters and records below the output, if there is one; returns the metrics."""
    began = time.perf_counter()
    config = PartitionConfig(p=args.p, seed=args.seed, sample_ratio=args.sample_ratio, inmem=args.inmem)
    graph = normalize(read_graph(spark, args.filename, args.filetype, args.strict))
    a = saved(assign(args.method, graph, config))
    validate(a, graph.n_edges, config.p)
    masters = saved(hash_masters(replicas(a), config.seed))
    row = metrics(a, config.p, graph.n_vertices, args.method).first().asDict()
    row |= {"expected_edges": graph.n_edges // config.p, "bucket_sizes": [r["n_edges"] for r in bucket_sizes(a, config.p).orderBy("bucket").collect()], "master_balance": master_balance(masters, config.p, graph.n_vertices).first()[0]}  # p rows
    if args.output:
        for name, df in (("vertices", graph.vertices), ("assignments", a), ("masters", masters), ("records", partition_records(a, masters))):
            df.write.mode("overwrite").parquet(f"{args.output}/{name}")
    return row | {"seconds": round(time.perf_counter() - began, 3)}


def parser() -> argparse.ArgumentParser:
    own = argparse.ArgumentParser(prog="edgeloom", description=__doc__)
    commands = own.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--filename", required=True)
    common.add_argument("--filetype", choices=FILE_TYPES, default="edgelist")
    common.add_argument("--strict", action="store_true", help="names that aren't numbers of 32 bits are errors")
    p = commands.add_parser("partition", parents=[common])
    p.add_argument("--method", choices=[*METHODS, *sorted(set(PARTITIONERS) - set(METHODS))], default="sne")
    p.add_argument("--p", type=int, default=10)
    p.add_argument("--sample-ratio", type=int, default=2, help="edges per vertex that sne keeps; other memory is bounded by Spark's own settings, spark.executor.memory and spark.sql.shuffle.partitions")
    p.add_argument("--inmem", action="store_true")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--output")
    c = commands.add_parser("convert", parents=[common])
    c.add_argument("--output", required=True)
    return own


def main(argv: list[str] | None = None) -> dict | None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("edgeloom").getOrCreate()
    ship(spark)
    if args.command == "convert":
        return write_edge_list(read_graph(spark, args.filename, args.filetype, args.strict), args.output)
    row = partition(spark, args)
    for k, v in row.items():
        print(f"{k}: {v}")
    return row


if __name__ == "__main__":
    main()
