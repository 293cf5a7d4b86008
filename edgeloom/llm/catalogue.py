"""The queries of this folder and the SQL of those that SQL can express."""

from . import bpe, exact_substrings, language_model, near_dedup, nearest, packing, quality_model, quality_rules, token_counts, url_filter

_MODULES = (bpe, nearest, near_dedup, exact_substrings, quality_model, url_filter, token_counts, packing, quality_rules, language_model)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in getattr(m, "ORACLE_SQL", {}).items()}
