"""Settings of a partitioning run."""

from __future__ import annotations

from dataclasses import dataclass

METHODS = ("random", "dbh", "hsfc", "ne", "sne")


@dataclass(frozen=True)
class PartitionConfig:
    """p buckets; seed of every random choice; SNE keeps sample_ratio edges per vertex, or all of them with inmem."""

    p: int = 10
    seed: int = 0
    sample_ratio: int = 2
    inmem: bool = False
    batch_edges: int | None = None

    def __post_init__(self):
        if self.p < 1:
            raise ValueError(f"p must be at least 1, not {self.p}")
        if self.sample_ratio < 1:
            raise ValueError(f"sample_ratio must be at least 1, not {self.sample_ratio}")
        if self.batch_edges is not None and self.batch_edges < 1:
            raise ValueError("batch_edges must be at least 1")

    def capacity(self, n_edges: int, ratio: float) -> int:
        return int(n_edges * ratio / self.p + 1)

    def batch(self, n_edges: int) -> int:
        return self.batch_edges or min(65536 // 8, max(1, int(n_edges * 0.05 / self.p + 1)))
