"""All registered queries; importing this package fills the registry."""

from docloom.plans import views  # noqa: F401  (registers the shared CTEs)
from docloom.plans.catalog import chunks, feeds, graph, quality, relations, reports, routing, search, structure, text  # noqa: F401
from docloom.plans.registry import QUERIES, oracles

ORACLES = oracles()

__all__ = ["QUERIES", "ORACLES"]
