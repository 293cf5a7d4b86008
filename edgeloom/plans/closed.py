"""Methods in which a bucket follows from the edge, its degrees or its rank: plain DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PartitionConfig
from ..functions import edge_hash, hilbert_encode, low_degree_endpoint, vertex_hash
from ..functions.hilbert import levels
from ..operators.graph import Graph
from ..operators.ranks import with_rank


def random(graph: Graph, config: PartitionConfig) -> DataFrame:
    """By a hash of both endpoints, whichever comes first. No shuffle."""
    return graph.edges.select("eid", "u", "v", edge_hash(F.col("u"), F.col("v"), config.p).cast("int").alias("bucket"))


def degree_based(graph: Graph, config: PartitionConfig) -> DataFrame:
    """By a hash of the endpoint of smaller degree, the first on ties."""
    low = low_degree_endpoint(F.col("u"), F.col("v"), F.col("du"), F.col("dv"))
    return graph.with_degrees().select("eid", "u", "v", vertex_hash(low, config.p).cast("int").alias("bucket"))


def hilbert_keys(graph: Graph) -> DataFrame:
    """edges with their place d on the curve through the grid of sources and targets."""
    return graph.edges.withColumn("d", hilbert_encode(F.col("u"), F.col("v"), levels(graph.n_vertices)))


def hilbert(graph: Graph, config: PartitionConfig) -> DataFrame:
    """By equal shares of the edges in the order of the curve: floor(E / p) + 1 to a bucket, so the last ones may be short or empty."""
    share = graph.n_edges // config.p + 1
    ranked = with_rank(hilbert_keys(graph), ["d", "eid"], "r")
    return ranked.select("eid", "u", "v", F.floor(F.col("r") / share).cast("int").alias("bucket"))
