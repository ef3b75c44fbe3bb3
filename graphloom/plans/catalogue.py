"""All registered queries and their SQL."""

from . import documents, entities, search, upkeep  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
