"""Neighbour expansion of the whole graph in one task, for graphs that fit in its memory; see frontier.py for those that don't."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PartitionConfig
from ..operators.graph import Graph
from .kernel import Expansion

SLACK = 1.0


def expand(u: np.ndarray, v: np.ndarray, n_vertices: int, config: PartitionConfig) -> np.ndarray:
    """The bucket of each edge; what is open after p - 1 buckets goes to the last."""
    e, rng = Expansion(u, v, n_vertices), np.random.default_rng(config.seed)
    capacity, average = config.capacity(len(u), SLACK), 2 * len(u) / n_vertices
    for b in range(config.p - 1):
        e.grow(b, capacity, capacity, average, rng, np.zeros(n_vertices, bool), np.zeros(n_vertices, bool), 0)
    return np.where(e.bucket < 0, config.p - 1, e.bucket)


def neighbour_expansion(graph: Graph, config: PartitionConfig) -> DataFrame:
    """Seeded, so the same edges give the same buckets."""
    n = graph.n_vertices

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t["eid"].to_numpy(), kind="stable")
        eid, u, v = (t[c].to_numpy()[order] for c in ("eid", "u", "v"))
        return pa.table({"eid": eid, "u": u, "v": v, "bucket": expand(u, v, n, config).astype(np.int32)})

    return graph.edges.groupBy().applyInArrow(run, "eid long, u long, v long, bucket int")
