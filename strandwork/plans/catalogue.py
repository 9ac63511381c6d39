"""All named queries of the core."""

from strandwork.plans import change_queries, contract_queries, join_queries, patch_queries, rank_queries, source_queries, state_queries, target_queries, text_queries  # noqa: F401
from strandwork.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
