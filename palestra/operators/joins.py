"""Joins that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
# Rows that one task of a shuffle join sorts at most, whatever the number of shuffle partitions.
ROWS_PER_TASK = 1_000_000


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True if the frame has at most ``max_rows`` rows. Reads no more than that many."""
    return df.limit(max_rows + 1).count() <= max_rows


@dataclass(frozen=True)
class Hint:
    """Carries the outcome of one size check to the joins it covers."""

    small: bool

    def __call__(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def by_key(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The frame hashed by key over as many partitions as ``rows`` rows need, at least the
    session's number, so that one task's share of a large join does not grow with the input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_PER_TASK)), key)


def beyond_session(spark: SparkSession, rows: int) -> int:
    """How many tasks ``rows`` rows need, if they are more than the session's number of
    partitions; otherwise 0."""
    tasks = -(-rows // ROWS_PER_TASK)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else 0


def rows_for(stored: DataFrame, batch: DataFrame, on: list[str], hint: Hint) -> DataFrame:
    """The rows of a large table whose key occurs in a batch. The table is only streamed
    past a batch that is small."""
    return stored.join(hint(batch.select(*on).distinct()), on, "left_semi")


def side_for(stored: DataFrame, batch: DataFrame, on: list[str], hint: Hint) -> DataFrame:
    """The stored side of a join with a batch. A small batch cuts it to ``rows_for``, which
    can be broadcast; past a broadcast the join drops the same rows in the shuffle it needs
    anyway, and a semi join before it would shuffle the batch once more."""
    return rows_for(stored, batch, on, hint) if hint.small else stored


def not_held_once(batch: DataFrame, stored: DataFrame, key: str, hint: Hint) -> DataFrame:
    """The keys of a batch that a table does not hold exactly once, and how often it ``held``
    them: few in sound data. NULL keys are left out."""
    asked = batch.select(key).where(F.col(key).isNotNull()).distinct()
    copies = stored.groupBy(key).agg(F.count("*").alias("held"))
    return (
        asked.join(hint(copies), key, "left")
        .withColumn("held", F.coalesce("held", F.lit(0)))
        .where("held <> 1")
    )


def split_left_join(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A left outer join in two parts, for a right side on which one key may own a large
    share of the rows: left rows with their partners, and left rows that have none.

    A skewed right side cannot be split in an outer join, but it can in the inner join of
    the first part; the second is an anti join on distinct keys, which are pre-aggregated
    before the shuffle.
    """
    matched = left.join(right, key)
    lonely = left.join(right.select(key).distinct(), key, "left_anti")
    return matched, lonely


def only_users(df: DataFrame, users, column: str = "userid") -> DataFrame:
    """Keep the rows of one user (a number), or of a set of users (a DataFrame)."""
    if isinstance(users, DataFrame):
        wanted = users.select(F.col(users.columns[0]).alias(column))
        return df.join(wanted, column, "left_semi").select(*df.columns)
    return df.where(F.col(column) == F.lit(users))
