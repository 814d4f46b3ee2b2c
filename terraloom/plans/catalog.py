"""All queries of the library, gathered from the modules that register them."""

from terraloom.plans import queries_graph, queries_lines, queries_names, queries_rivers, queries_rules, queries_shapes, queries_spatial
from terraloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_graph", "queries_lines", "queries_names", "queries_rivers", "queries_rules", "queries_shapes", "queries_spatial"]
