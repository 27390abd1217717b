"""Runnable queries over the driver's tables, one per operator, with SQL twins."""

from quire.catalog import documents, lines, notes, reading, regions, sources, tables, text  # noqa: F401
from quire.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
