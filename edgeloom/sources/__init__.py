"""Readers and writers of graphs. raw(line_no, src, dst) is what every reader gives."""

from .binary import partition_records, read_binary_edges, read_degrees, read_partition_file, read_partition_records, write_binary_edges, write_partition_file, write_partition_records
from .text import parse_adjacency, parse_edges, read_graph, write_edge_list

__all__ = ["parse_adjacency", "parse_edges", "partition_records", "read_binary_edges", "read_degrees", "read_graph", "read_partition_file", "read_partition_records", "write_binary_edges", "write_edge_list", "write_partition_file", "write_partition_records"]
