"""Queries, intake jobs and data rules for a fitness club, on PySpark."""

from palestra.asof import AsOf
from palestra.sources.tables import ClubTables, read_tables

__all__ = ["AsOf", "ClubTables", "read_tables"]
