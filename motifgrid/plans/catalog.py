"""All queries of the library with their equivalents in SQL."""

from . import counting, relating, shapes  # noqa: F401  they register their queries
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
