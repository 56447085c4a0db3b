"""The rows the three lookup tables start with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palestra.asof import AsOf
from palestra.sources.schema import TABLES

# The club's user types, machine states and plans.
SEED_ROWS = {
    "usertype": [(1, "Gestor"), (2, "Instrutor"), (3, "Membro")],
    "machinestatus": [(1, "Em manutenção"), (2, "Em funcionamento"), (3, "Avariada")],
    "plan": [
        (1, "Basico", "20.00", False, "Apenas tem acesso durante o horário de funcionamento", True),
        (2, "Premium", "30.00", True, "Acesso 24/7 com todas as comodidades", True),
        (3, "Estudante", "15.00", True, "Tarifa especial para estudantes", True),
    ],
}

MEMBER_USER_TYPE = 3


def _sql_literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def seed_values(name: str) -> str:
    """The rows of a lookup table as a SQL VALUES list."""
    rows = ["(" + ", ".join(map(_sql_literal, row)) + ")" for row in SEED_ROWS[name]]
    return "VALUES " + ", ".join(rows)


def seed_table(spark: SparkSession, name: str, as_of: AsOf) -> DataFrame:
    """A lookup table with its first rows; a local relation, so Spark knows its size."""
    table = TABLES[name]
    given = table.names[: len(SEED_ROWS[name][0])]
    rows = spark.sql(f"SELECT * FROM {seed_values(name)} AS t({', '.join(given)})")
    stamped = rows.withColumns({c: as_of.timestamp() for c in table.names if c not in given})
    return stamped.select(
        *[F.col(c.name).cast(c.spark_type).alias(c.name) for c in table.columns]
    )
