"""Inserts, updates, deletes and key changes as new versions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palestra.asof import AsOf
from palestra.operators.joins import Hint, by_key, fits, rows_for
from palestra.sources.schema import REFERENCES, TABLES
from palestra.sources.tables import ClubTables


def with_defaults(df: DataFrame, table: str, as_of: AsOf) -> DataFrame:
    """Complete rows for an insert: columns that are absent get the table's default, or
    NULL where there is none. A column that is present stays as given, NULLs included."""
    clock = {"today": as_of.today(), "now": as_of.timestamp(), "time": F.lit(as_of.time_us)}
    out = []
    for c in TABLES[table].columns:
        if c.name in df.columns:
            value = F.col(c.name)
        elif isinstance(c.default, str) and c.default in clock:
            value = clock[c.default]
        else:
            value = F.lit(c.default)
        out.append(value.cast(c.spark_type).alias(c.name))
    return df.select(*out)


def _stamped(df: DataFrame, touched, as_of: AsOf) -> DataFrame:
    if "updated_at" not in df.columns:
        return df
    return df.withColumn(
        "updated_at", F.when(touched, as_of.timestamp()).otherwise(F.col("updated_at"))
    )


def update_rows(
    stored: DataFrame, key: str, changes: DataFrame, as_of: AsOf
) -> tuple[DataFrame, DataFrame]:
    """Apply changes, at most one row per key, to a stored table.

    Returns the new version, in which touched rows carry ``updated_at``, and the changes
    whose key is unknown. The table is only streamed past a small number of changes.
    """
    hint = Hint(fits(changes))
    columns = [c for c in changes.columns if c != key]
    marked = changes.select(
        key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_touched")
    )
    joined = stored.join(hint(marked), key, "left")
    touched = F.col("_touched").isNotNull()
    for c in columns:
        joined = joined.withColumn(c, F.when(touched, F.col(f"_new_{c}")).otherwise(F.col(c)))
    after = _stamped(joined, touched, as_of).select(*stored.columns)
    known = rows_for(stored.select(key), changes, [key], hint)
    return after, changes.join(hint(known), key, "left_anti")


def update_where(df: DataFrame, condition, values: dict, as_of: AsOf) -> DataFrame:
    """Rows chosen by a condition get new values and ``updated_at``; one pass, no join."""
    touched = F.coalesce(condition, F.lit(False)).alias("_touched")
    marked = df.select("*", touched)
    chosen = F.col("_touched")
    out = marked.withColumns(
        {c: F.when(chosen, value).otherwise(F.col(c)) for c, value in values.items()}
    )
    return _stamped(out, chosen, as_of).select(*df.columns)


def delete_rows(
    tables: ClubTables, parent: str, keys: DataFrame, as_of: AsOf
) -> tuple[ClubTables, DataFrame]:
    """Delete rows by key, each request on its own.

    A key that a restricting child still uses is refused; other children get their column
    cleared. Returns the new tables and the refused keys with the children that hold them.
    """
    key = TABLES[parent].key
    wanted = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
    hint = Hint(fits(wanted))
    # Past a broadcast, both sides of each join are hashed alike over partitions that follow
    # the larger side's rows.
    spread = (lambda df, rows, on=key: df) if hint.small else (lambda df, rows, on=key: by_key(df, on, rows))
    table_rows = 0 if hint.small else tables[parent].count()
    # keys are unique in the parent
    present = spread(tables[parent].select(key), table_rows).join(
        hint(spread(wanted, table_rows)), key, "left_semi"
    )
    children = [r for r in REFERENCES if r.parent == parent]

    refused = None
    for ref in (r for r in children if r.on_delete == "restrict"):
        users = tables[ref.child].select(F.col(ref.column).alias(key))
        child_rows = 0 if hint.small else users.count()
        held = rows_for(spread(users, child_rows), spread(present, child_rows), [key], hint).distinct()
        held = held.withColumn("held_by", F.lit(ref.child))
        refused = held if refused is None else refused.unionByName(held)
    if refused is None:
        refused, deleted = present.withColumn("held_by", F.lit("")).where(F.lit(False)), present
    else:
        deleted = present.join(hint(refused.select(key).distinct()), key, "left_anti")

    frames = {
        parent: spread(tables[parent], table_rows).join(hint(spread(deleted, table_rows)), key, "left_anti")
    }
    for ref in (r for r in children if r.on_delete == "set null"):
        gone = deleted.select(F.col(key).alias(ref.column), F.lit(True).alias("_gone"))
        child_rows = 0 if hint.small else tables[ref.child].count()
        child = spread(tables[ref.child], child_rows, ref.column).join(
            hint(spread(gone, child_rows, ref.column)), ref.column, "left"
        )
        cleared = F.col("_gone").isNotNull()
        child = child.withColumn(ref.column, F.when(~cleared, F.col(ref.column)))
        frames[ref.child] = _stamped(child, cleared, as_of).select(*TABLES[ref.child].names)
    return tables.with_tables(**frames), refused


def change_keys(
    tables: ClubTables, parent: str, renames: DataFrame, as_of: AsOf
) -> tuple[ClubTables, DataFrame]:
    """Give rows new keys and let every child follow.

    ``renames`` has ``old_key`` and ``new_key``. A rename is refused if its old key is
    unknown or asked for twice, or its new key is in use or asked for twice.
    """
    table = TABLES[parent]
    hint = Hint(fits(renames))
    once = renames
    for column in ("old_key", "new_key"):
        asked = renames.groupBy(column).agg(F.count("*").alias("_n")).where("_n = 1")
        once = once.join(asked.select(column), column, "left_semi")
    keys = tables[parent].select(table.key)
    found = rows_for(keys.toDF("old_key"), renames, ["old_key"], hint)
    clash = rows_for(keys.toDF("new_key"), renames, ["new_key"], hint)
    good = (
        once.join(hint(found), "old_key", "left_semi")
        .join(hint(clash), "new_key", "left_anti")
        .select("old_key", "new_key")
    )
    refused = renames.join(good, ["old_key", "new_key"], "left_anti")

    frames = {}
    children = [(r.child, r.column) for r in REFERENCES if r.parent == parent]
    targets = [(parent, table.key), *children]
    for name, column in targets:
        moved = good.select(F.col("old_key").alias(column), "new_key")
        df = tables[name].join(hint(moved), column, "left")
        touched = F.col("new_key").isNotNull()
        kind = TABLES[name].column(column).spark_type
        df = df.withColumn(column, F.coalesce(F.col("new_key").cast(kind), F.col(column)))
        frames[name] = _stamped(df, touched, as_of).select(*TABLES[name].names)
    return tables.with_tables(**frames), refused
