"""Checks of rows, of uniqueness and of references."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palestra.operators.joins import ROWS_PER_TASK
from palestra.sources.schema import TABLES, Reference


@dataclass(frozen=True)
class RowRule:
    """A condition on one row. A NULL outcome passes."""

    rule: str
    table: str
    condition: Callable[[], Column]


def _breaks(rule: RowRule) -> Column:
    """TRUE if the row breaks the rule; otherwise FALSE or NULL."""
    return ~rule.condition()


def breaks_any(rules: list[RowRule]) -> Column:
    """Whether a row breaks at least one of the rules."""
    return F.coalesce(
        reduce(Column.__or__, [_breaks(rule) for rule in rules], F.lit(False)), F.lit(False)
    )


def failed_rules(rules: list[RowRule]) -> Column:
    """The names of the rules a row breaks, as an array."""
    return F.array_compact(F.array(*[F.when(_breaks(r), F.lit(r.rule)) for r in rules]))


def check(df: DataFrame, rules: list[RowRule]) -> tuple[DataFrame, DataFrame]:
    """Split rows into valid ones and rejects; rejects list their broken ``rules``."""
    broken = breaks_any(rules)
    return df.where(~broken), df.where(broken).withColumn("rules", failed_rules(rules))


def row_violations(df: DataFrame, table: str, rules: list[RowRule]) -> DataFrame:
    """One line per broken rule and row. Sound rows only meet the filter; the rules are
    told apart on the others."""
    return df.where(breaks_any(rules)).select(
        F.lit(table).alias("table_name"),
        F.explode(failed_rules(rules)).alias("rule"),
        F.col(TABLES[table].key).cast("bigint").alias("row_id"),
    )


def later_copies(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose value some row with a lower key already has. NULLs never collide.

    Values that occur once fall out of a pre-aggregated count; rows of the others, which
    are few in sound data, are matched by value, a join whose skewed side can be split.
    """
    filled = df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    shared = (
        filled.groupBy(*columns).agg(F.min(key).alias("_lowest"), F.count("*").alias("_n"))
        .where("_n > 1").select(*columns, "_lowest")
    )
    return filled.join(shared, columns).where(F.col(key) > F.col("_lowest")).select(*df.columns)


def unique_violations(df: DataFrame, table: str, columns: tuple[str, ...]) -> DataFrame:
    key = TABLES[table].key
    return later_copies(df, key, list(columns)).select(
        F.lit(table).alias("table_name"),
        F.lit("unique:" + "+".join(columns)).alias("rule"),
        F.col(key).cast("bigint").alias("row_id"),
    )


def key_violations(df: DataFrame, table: str) -> DataFrame:
    """Keys that occur more than once, with the number of surplus rows."""
    key = TABLES[table].key
    return (
        df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
        .select(
            F.lit(table).alias("table_name"),
            F.col(key).cast("bigint").alias("row_id"),
            (F.col("_n") - 1).alias("surplus"),
        )
    )


def orphans(child: DataFrame, ref: Reference, parent: DataFrame) -> DataFrame:
    """Rows that point at a missing parent. NULL pointers pass."""
    keys = parent.select(F.col(TABLES[ref.parent].key).alias(ref.column))
    pointers = child.select(ref.column).where(F.col(ref.column).isNotNull()).distinct()
    missing = pointers.join(keys, ref.column, "left_anti")
    return child.join(missing, ref.column, "left_semi").select(*child.columns)


def reference_violations(child: DataFrame, ref: Reference, parent: DataFrame) -> DataFrame:
    return orphans(child, ref, parent).select(
        F.lit(ref.child).alias("table_name"),
        F.lit(f"reference:{ref.column}").alias("rule"),
        F.col(TABLES[ref.child].key).cast("bigint").alias("row_id"),
    )


def row_counts(df: DataFrame, table: str, rules: list[RowRule]) -> DataFrame:
    """How many rows break each rule, in one pass that sends one row per task."""
    names = [r.rule for r in rules]
    counts = df.agg(*[F.count_if(_breaks(r)).alias(r.rule) for r in rules])
    return counts.unpivot([], names, "rule", "broken").select(
        F.lit(table).alias("table_name"), "rule", "broken"
    )


def value_rows(df: DataFrame, table: str, references: tuple[Reference, ...]) -> DataFrame:
    """What uniqueness and references are judged by, in one pass over a table: per row its
    unique values, its pointers, and its key for each reference to it."""

    def entry(rule_table: str, rule: str, columns, kind: str) -> Column:
        filled = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
        # bigint keys and int pointers must give the same text
        value = F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))
        return F.when(filled, F.struct(
            F.lit(rule_table).alias("table_name"), F.lit(rule).alias("rule"),
            value.alias("value"), F.lit(kind).alias("kind"),
        ))

    key = TABLES[table].key
    entries = [entry(table, "unique:" + "+".join(c), c, "unique") for c in TABLES[table].unique]
    entries += [entry(table, f"reference:{r.column}", [r.column], "pointer")
                for r in references if r.child == table]
    entries += [entry(r.child, f"reference:{r.column}", [key], "key")
                for r in references if r.parent == table]
    return df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")


def spread_values(values: DataFrame) -> DataFrame:
    """The values hashed over as many tasks as their number needs, at least the session's
    number. Keys and unique values are nearly all distinct, so adding them up before the
    shuffle saves nothing, and one task's share of a fixed number of tasks grows with them."""
    least = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-values.count() // ROWS_PER_TASK))
    return values.repartition(tasks, "table_name", "rule", "value")


def value_counts(values: DataFrame) -> DataFrame:
    """How many rows break each rule of uniqueness and reference, from one aggregate over the
    values of all tables."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    groups = spread_values(values).groupBy("table_name", "rule", "value").agg(
        of("unique").alias("holders"), of("pointer").alias("pointers"), of("key").alias("keys")
    )
    broken = F.when(F.col("holders") > 1, F.col("holders") - 1).when(
        F.col("keys") == 0, F.col("pointers")
    ).otherwise(F.lit(0))
    judged = groups.withColumn("broken", F.when(F.col("holders") == 1, F.lit(0)).otherwise(broken))
    return judged.where("broken > 0").select("table_name", "rule", "broken")
