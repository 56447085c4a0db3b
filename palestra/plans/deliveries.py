"""Deliveries of whole tables, judged in the pass that writes them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from palestra.operators.checks import RowRule, failed_rules
from palestra.plans.club_rules import rules_of


@dataclass(frozen=True)
class Delivery:
    """``counts`` holds ``table_name``, ``rule`` and the rows that ``broken`` it, for rules that
    some row breaks; ``total`` is the number of rows delivered."""

    valid: DataFrame
    rejects: DataFrame
    counts: DataFrame
    total: int


def take_delivery(df: DataFrame, table: str, path: str, rules: list[RowRule] | None = None) -> Delivery:
    """Write a delivery to ``path``, sound rows and rejects apart, and count broken rules.

    One scan does all: each row's broken rules are found once, observed by count where the
    rows are written, and written with the rejects. Nothing is shuffled. The counts are one
    number per rule, whatever the size of the delivery.
    """
    rules = rules_of(table) if rules is None else rules
    judged = df.withColumn("rules", failed_rules(rules))
    seen = Observation()
    observed = judged.observe(
        seen, F.count("*").alias("total"),
        *[F.count_if(F.array_contains("rules", r.rule)).alias(f"r{k}") for k, r in enumerate(rules)],
    )
    sound = (F.size("rules") == 0).alias("sound")
    observed.select("*", sound).write.mode("overwrite").partitionBy("sound").parquet(path)
    spark = df.sparkSession
    found = [(table, r.rule, seen.get[f"r{k}"]) for k, r in enumerate(rules) if seen.get[f"r{k}"]]
    schema = judged.select("*", sound).schema
    stored = spark.read.schema(schema).parquet(path)
    return Delivery(
        stored.where("sound").select(*df.columns),
        stored.where("NOT sound").select(*df.columns, "rules"),
        spark.createDataFrame(found, "table_name STRING, rule STRING, broken BIGINT"),
        seen.get["total"],
    )
