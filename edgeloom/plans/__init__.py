"""The ways to split edges: assign(method, graph, config) gives assignments(eid, u, v, bucket)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import METHODS, PartitionConfig
from ..operators.graph import Graph
from . import closed, expansion, frontier, streamed


def _from_files(graph: Graph, config: PartitionConfig) -> DataFrame:
    from ..streaming import stream_partition  # which imports from here

    return stream_partition(graph, config)


PARTITIONERS = {"random": closed.random, "dbh": closed.degree_based, "hsfc": closed.hilbert, "ne": expansion.neighbour_expansion, "sne": streamed.streaming_expansion, "sne_stream": _from_files, "ne_frontier": frontier.frontier_expansion}


def assign(method: str, graph: Graph, config: PartitionConfig) -> DataFrame:
    if method not in PARTITIONERS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    return PARTITIONERS[method](graph, config)


__all__ = ["PARTITIONERS", "assign"]
