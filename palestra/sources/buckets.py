"""Tables cut into buckets by the key they are joined on, so that joins need no shuffle.

Visits lie in buckets of their member beside the members' names, and payments in buckets of
their subscription beside the payers; each bucket is one sorted file. A bucket is one task of
a join: a member with a large share of all visits makes one long task, which adaptive skew
handling splits only where the tables are not in buckets. Choose them for even keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from palestra.plans.parts import member_names
from palestra.plans.views import payers
from palestra.sources.tables import ClubTables

# Table or prepared side, and the column of its buckets.
BUCKETS = {
    "checkin": "memberid",
    "member": "memberid",
    "member_names": "memberid",
    "payment": "subscriptionid",
    "payers": "subscriptionid",
}


def _save(df: DataFrame, name: str, table: str, folder: str, buckets: int) -> None:
    column = BUCKETS[name]
    (
        df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column)
        .option("path", f"{folder}/{name}").mode("overwrite").format("parquet").saveAsTable(table)
    )


def write_buckets(t: ClubTables, folder: str, prefix: str, buckets: int) -> None:
    """Store the tables and sides as catalog tables ``<prefix><name>`` below the folder."""
    sides = {"member_names": member_names(t), "payers": payers(t)}
    for name in BUCKETS:
        _save(sides[name] if name in sides else t[name], name, f"{prefix}{name}", folder, buckets)


def with_buckets(t: ClubTables, prefix: str) -> ClubTables:
    """The tables with those that are stored in buckets in their place."""
    return t.with_tables(**{name: t.spark.table(f"{prefix}{name}") for name in BUCKETS})
