"""All query modules, imported so that they register."""

from tallyforge.plans import aggregates, connectors, joins, projections, reports, statistics, texts  # noqa: F401
from tallyforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
