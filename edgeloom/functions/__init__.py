"""Scalar functions as Columns: edge and vertex hashes, the Hilbert curve, lenient integers, record escaping."""

from .hashes import edge_hash, low_degree_endpoint, vertex_hash
from .hilbert import decode as hilbert_decode
from .hilbert import encode as hilbert_encode
from .hilbert import side as hilbert_side
from .text import lenient_id, strict_id

__all__ = ["edge_hash", "hilbert_decode", "hilbert_encode", "hilbert_side", "lenient_id", "low_degree_endpoint", "strict_id", "vertex_hash"]
