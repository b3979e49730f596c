"""All queries and their SQL; the modules below add theirs to the catalog's when they are imported."""

from playlog.plans import discovery, sources, upkeep  # noqa: F401
from playlog.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
