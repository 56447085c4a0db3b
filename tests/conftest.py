import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from palestra.asof import AsOf  # noqa: E402
from palestra.session import local_session  # noqa: E402
from palestra.sources.schema import _TYPES, TABLES  # noqa: E402
from palestra.sources.seeds import SEED_ROWS, seed_table  # noqa: E402
from palestra.sources.tables import ClubTables  # noqa: E402

NOW = AsOf(dt.datetime(2024, 2, 29, 9, 30, 0))
HOUR = 3_600_000_000
MINUTE = 60_000_000


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=2)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


_ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "time": pa.int64(), "string": pa.string(),
    "boolean": pa.bool_(), "date": pa.date32(), "money": pa.decimal128(10, 2),
    "timestamp": pa.timestamp("us"),
}
_CLOCK = {"today": NOW.date, "now": NOW.ts, "time": NOW.time_us}


def _value(column, row):
    value = row.get(column.name, _CLOCK.get(column.default, column.default))
    return Decimal(value) if column.kind == "money" and value is not None else value


def local(spark, columns, rows):
    """A small frame whose size Spark knows; columns are (name, kind) pairs."""
    arrow = pa.schema([pa.field(name, _ARROW[kind]) for name, kind in columns])
    schema = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns])
    data = [dict(zip([name for name, _ in columns], row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=arrow), schema)


def frame(spark, name, rows):
    """Rows given as dicts; absent columns get the table's defaults."""
    columns = TABLES[name].columns
    data = [tuple(_value(c, r) for c in columns) for r in rows]
    return local(spark, [(c.name, c.kind) for c in columns], data)


def club(spark, **rows):
    """Hand-made tables; the lookup tables hold their first rows unless given."""

    def loader(name):
        if name in SEED_ROWS and name not in rows:
            return lambda: seed_table(spark, name, NOW)
        if not rows.get(name):
            return lambda: spark.createDataFrame([], TABLES[name].struct)
        return lambda: frame(spark, name, rows[name])

    return ClubTables(spark, {name: loader(name) for name in TABLES})


def day(text):
    return dt.date.fromisoformat(text)


def moment(text):
    return dt.datetime.fromisoformat(text)


def dicts(df):
    return [r.asDict() for r in df.collect()]
