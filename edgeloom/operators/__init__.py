"""Operators over graphs: numbering, degrees, incidence, metrics, bucket sets, masters, orders."""

from .graph import Graph, normalize
from .masters import hash_masters, quota_masters
from .metrics import bucket_sizes, metrics, mirrors_per_bucket, replicas
from .orders import external_sort, smallest, shuffled
from .ranks import with_rank
from .sets import complement, difference, intersection, set_size, union

__all__ = ["Graph", "bucket_sizes", "complement", "difference", "external_sort", "hash_masters", "intersection", "metrics", "mirrors_per_bucket", "normalize", "quota_masters", "replicas", "set_size", "shuffled", "smallest", "union", "with_rank"]
