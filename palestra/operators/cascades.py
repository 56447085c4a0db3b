"""Deletes and key changes over several tables at once, in the order of their references."""

from __future__ import annotations

from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palestra.asof import AsOf
from palestra.operators.changes import change_keys, delete_rows
from palestra.sources.schema import REFERENCES, TABLES
from palestra.sources.tables import ClubTables


def children_first(names) -> list[str]:
    """Tables in an order in which each comes after all tables that point at it."""
    graph = {name: {r.child for r in REFERENCES if r.parent == name} for name in TABLES}
    return [name for name in TopologicalSorter(graph).static_order() if name in names]


def delete_batch(
    tables: ClubTables, wanted: dict[str, DataFrame], as_of: AsOf
) -> tuple[ClubTables, DataFrame]:
    """Delete rows of several tables by key (the first column of each frame).

    Children are judged before their parents, so a member can go together with its bookings.
    A key that a restricting child still uses then is refused, with the child that holds it;
    columns that only point are cleared. Returns the new tables and the refused
    ``table_name``, ``row_id``, ``held_by``.
    """
    refused = None
    for name in children_first(wanted):
        tables, held = delete_rows(tables, name, wanted[name], as_of)
        held = held.select(
            F.lit(name).alias("table_name"), F.col(TABLES[name].key).cast("bigint").alias("row_id"), "held_by"
        )
        refused = held if refused is None else refused.unionByName(held)
    return tables, refused


def change_batch(
    tables: ClubTables, renames: dict[str, DataFrame], as_of: AsOf
) -> tuple[ClubTables, DataFrame]:
    """Give rows of several tables new keys (``old_key``, ``new_key``); all children follow.
    Returns the new tables and the refused renames with their ``table_name``."""
    refused = None
    for name in children_first(renames):
        tables, bad = change_keys(tables, name, renames[name], as_of)
        bad = bad.select(
            F.lit(name).alias("table_name"), *[F.col(c).cast("bigint").alias(c) for c in ("old_key", "new_key")]
        )
        refused = bad if refused is None else refused.unionByName(bad)
    return tables, refused
