"""A graph with dense vertex ids."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from .ranks import with_rank


@dataclass(frozen=True)
class Graph:
    """vertices(vid, name), edges(eid, u, v): directed pairs of dense ids, parallel edges kept, no self-loops."""

    vertices: DataFrame
    edges: DataFrame

    @cached_property
    def n_vertices(self) -> int:
        return self.vertices.count()

    @cached_property
    def n_edges(self) -> int:
        return self.edges.count()

    def degrees(self) -> DataFrame:
        """(vid, degree): incoming and outgoing edges, parallel ones too."""
        return self.edges.select(F.explode(F.array("u", "v")).alias("vid")).groupBy("vid").agg(F.count("*").alias("degree"))

    def with_degrees(self) -> DataFrame:
        """edges with the degrees du and dv of their endpoints."""
        d = self.degrees()
        return self.edges.join(d.select(F.col("vid").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("vid").alias("v"), F.col("degree").alias("dv")), "v").select("eid", "u", "v", "du", "dv")

    def incidence(self) -> DataFrame:
        """(vid, eid, other, out): every edge once from either end."""
        return self.edges.select("eid", F.explode(F.array(F.struct(F.col("u").alias("vid"), F.col("v").alias("other"), F.lit(True).alias("out")), F.struct(F.col("v").alias("vid"), F.col("u").alias("other"), F.lit(False).alias("out")))).alias("x")).select("x.vid", "eid", "x.other", "x.out")

    def adjacency(self, by: str = "u") -> DataFrame:
        """(vid, n, first_eid, last_eid) of the edges by source (u) or by target (v): the extent of each vertex's list."""
        return self.edges.groupBy(F.col(by).alias("vid")).agg(F.count("*").alias("n"), F.min("eid").alias("first_eid"), F.max("eid").alias("last_eid"))


def normalize(raw: DataFrame) -> Graph:
    """A graph from raw(line_no, src, dst). Names get ids in the order in which they first come, sources before targets of the same line.

    Self-loops go first, so a vertex that has nothing else gets no id. No edges at all raise.
    """
    e = saved(raw.where("src <> dst").select("line_no", "src", "dst"))
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("name"), (2 * F.col("line_no")).alias("at")), F.struct(F.col("dst").alias("name"), (2 * F.col("line_no") + 1).alias("at")))).alias("x")).select("x.*")
    vertices = saved(with_rank(ends.groupBy("name").agg(F.min("at").alias("at")), ["at"], "vid").select("vid", "name"))
    if vertices.isEmpty():
        raise ValueError("the graph has no edges")
    names = lambda k, v: vertices.select(F.col("name").alias(k), F.col("vid").alias(v))
    edges = e.join(names("src", "u"), "src").join(names("dst", "v"), "dst").select(F.col("line_no").alias("eid"), "u", "v")
    return Graph(vertices, saved(edges))
