"""The club's tables from a PostgreSQL database, read in parallel by key range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palestra.sources.schema import TABLES
from palestra.sources.tables import ClubTables

DRIVER = "org.postgresql.Driver"


def source_query(name: str) -> str:
    """A table as a subquery in which times of day are microseconds."""
    columns = [
        f"CAST(EXTRACT(EPOCH FROM {c.name}) * 1000000 AS BIGINT) AS {c.name}"
        if c.kind == "time"
        else c.name
        for c in TABLES[name].columns
    ]
    return f"(SELECT {', '.join(columns)} FROM {name}) AS {name}"


def connection_options(url: str, user: str, password: str) -> dict[str, str]:
    return {"url": url, "user": user, "password": password, "driver": DRIVER}


def range_options(name: str, low: int, high: int, partitions: int) -> dict[str, str]:
    """Options that cut a table into key ranges, each read by one task."""
    return {
        "dbtable": source_query(name),
        "partitionColumn": TABLES[name].key,
        "lowerBound": str(low),
        "upperBound": str(high + 1),
        "numPartitions": str(max(1, min(partitions, high - low + 1))),
        "preferTimestampNTZ": "true",
    }


def read_jdbc_table(
    spark: SparkSession, name: str, connection: dict[str, str], partitions: int
) -> DataFrame:
    key = TABLES[name].key
    reader = spark.read.format("jdbc").options(**connection)
    bounds = reader.option(
        "query", f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {name}"
    ).load().first()
    low, high = bounds["low"] or 0, bounds["high"] or 0
    options = {**connection, **range_options(name, low, high, partitions)}
    df = spark.read.format("jdbc").options(**options).load()
    return df.select(*[df[c.name].cast(c.spark_type).alias(c.name) for c in TABLES[name].columns])


def jdbc_tables(
    spark: SparkSession, url: str, user: str, password: str, partitions: int = 32
) -> ClubTables:
    connection = connection_options(url, user, password)

    def loader(name: str):
        return lambda: read_jdbc_table(spark, name, connection, partitions)

    return ClubTables(spark, {name: loader(name) for name in TABLES})
