"""A table that is delivered anew against the one in store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palestra.asof import AsOf
from palestra.operators.changes import with_defaults
from palestra.operators.joins import Hint, fits
from palestra.session import durable
from palestra.sources.schema import TABLES

STAMPS = ("created_at", "updated_at")


def row_hash(columns: list[str]) -> Column:
    """A hash of a row's values; a NULL differs from any value and keeps its place."""
    return F.xxhash64(*columns, F.array(*[F.col(c).isNull() for c in columns]))


def differences(
    stored: DataFrame, delivered: DataFrame, key: str, ignore: tuple[str, ...] = STAMPS
) -> DataFrame:
    """The keys that the delivery inserts, changes or removes, with the ``kind`` of change.

    Only keys and hashes are shuffled, once for both sides together. Keys are unique on each
    side. Columns that the delivery lacks are not compared.
    """
    columns = [c for c in stored.columns if c in delivered.columns and c not in (key, *ignore)]
    sides = [
        df.select(key, F.lit(side).alias("side"), row_hash(columns).alias("told"))
        for side, df in (("stored", stored), ("delivered", delivered))
    ]
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("told")))
    both = sides[0].unionByName(sides[1]).groupBy(key).agg(
        of("stored").alias("before"), of("delivered").alias("after")
    )
    kind = (
        F.when(F.col("before").isNull(), F.lit("inserted"))
        .when(F.col("after").isNull(), F.lit("removed"))
        .when(F.col("before") != F.col("after"), F.lit("changed"))
    )
    return both.select(key, kind.alias("kind")).where("kind IS NOT NULL")


def redelivered(
    stored: DataFrame, delivered: DataFrame, table: str, as_of: AsOf, remove: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The new version of a table after a full delivery, and what is different.

    Unchanged rows stay as they are, with their ``updated_at``; changed ones get the delivered
    values and ``updated_at``, inserted ones the table's defaults. ``remove`` says whether rows
    that the delivery lacks go. Whole rows are read only for keys that differ.
    """
    key = TABLES[table].key
    different = durable(differences(stored, delivered, key))
    hint = Hint(fits(different))
    gone = different if remove else different.where("kind <> 'removed'")
    same = stored.join(hint(gone.select(key)), key, "left_anti").select(*TABLES[table].names)

    def of(kind: str) -> DataFrame:
        return different.where(F.col("kind") == kind).select(key)

    given = [c for c in TABLES[table].names if c in delivered.columns and c not in STAMPS]
    inserted = delivered.select(*given).join(hint(of("inserted")), key, "left_semi")
    changed = delivered.select(*given).join(hint(of("changed")), key, "left_semi")
    kept = [c for c in TABLES[table].names if c not in given and c != "updated_at"]
    old = stored.select(key, *kept).join(hint(of("changed")), key, "left_semi")
    after = changed.join(old, key)
    if "updated_at" in TABLES[table].names:
        after = after.withColumn("updated_at", as_of.timestamp())
    new = with_defaults(inserted.select(*given), table, as_of)
    return same.unionByName(after.select(*TABLES[table].names)).unionByName(new), different
