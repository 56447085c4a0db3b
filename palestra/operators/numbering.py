"""Consecutive numbers for new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palestra.operators.joins import beyond_session
from palestra.session import durable

_ROW_BITS = 33


def numbered(
    df: DataFrame, order: list[str], column: str = "position", n_rows: int = 0
) -> DataFrame:
    """Add 1, 2, 3, ... in the given order, which should end in a unique column. ``n_rows``,
    if known, cuts the rows into more ranges than the session's number where they need them.

    The rows are cut into ranges, placed within their range and stored, so that a number
    never depends on which task ran when. Only one count per range goes through a single
    task. Rows that share all order columns but the last are still cut apart.
    """
    tasks = beyond_session(df.sparkSession, n_rows)
    ranges = df.repartitionByRange(*([tasks] if tasks else []), *order).sortWithinPartitions(*order)
    # within a partition monotonically_increasing_id counts rows in its low bits
    placed = durable(
        ranges.withColumns(
            {
                "_part": F.spark_partition_id(),
                "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
            }
        ),
        codec="zstd",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    # at most one row per shuffle partition
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_at") + 1).alias(column)
    )


def highest_key(df: DataFrame, key: str) -> int:
    """The largest key in use, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).first()[0]
