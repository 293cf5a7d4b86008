"""Streaming neighbour expansion over Structured Streaming."""

from .expansion import StreamPartitioner, stream_partition

__all__ = ["StreamPartitioner", "stream_partition"]
