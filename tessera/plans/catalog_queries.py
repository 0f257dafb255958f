"""All registered queries of the catalog operators and their SQL twins."""

from tessera.plans import export_queries, function_queries, rule_queries, search_queries  # noqa: F401  (registration)
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
