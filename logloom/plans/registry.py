"""The named queries and their SQL."""

from logloom.plans import versions  # noqa: F401  adds its queries
from logloom.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
