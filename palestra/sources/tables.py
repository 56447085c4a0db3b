"""A set of the club's tables, each loaded when first used."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from palestra.sources.schema import PARTITION_COLUMNS, SORT_COLUMNS, TABLES


class ClubTables:
    """Table name to DataFrame. ``with_tables`` gives a copy with some replaced."""

    def __init__(self, spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._loaders = dict(loaders)
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._loaders[name]()
        return self._frames[name]

    def __contains__(self, name: str) -> bool:
        return name in self._loaders

    def __iter__(self):
        return iter(self._loaders)

    def with_tables(self, **frames: DataFrame) -> ClubTables:
        loaders = dict(self._loaders)
        for name, frame in frames.items():
            loaders[name] = lambda frame=frame: frame
        return ClubTables(self.spark, loaders)

    def register_views(self, names: Iterable[str] | None = None) -> None:
        """Make the tables readable by name in ``spark.sql``."""
        for name in names or self:
            self[name].createOrReplaceTempView(name)


def read_tables(spark: SparkSession, root: str) -> ClubTables:
    """Tables stored by ``write_table`` under one root folder."""

    def loader(name: str):
        return lambda: (
            spark.read.schema(TABLES[name].struct).parquet(f"{root}/{name}")
            .select(*TABLES[name].names)
        )

    return ClubTables(spark, {name: loader(name) for name in TABLES})


def write_table(df: DataFrame, name: str, path: str, mode: str = "overwrite") -> None:
    """Write one table in its layout: cut by date where queries filter on a date.

    Rows are spread by date and key before the write, so a date that holds a large
    share of the rows is written by many tasks and each task touches few dates.
    """
    table = TABLES[name]
    out = df.select(*[df[c.name].cast(c.spark_type).alias(c.name) for c in table.columns])
    cut = PARTITION_COLUMNS.get(name, [])
    order = [*cut, *SORT_COLUMNS.get(name, [])]
    if cut:
        out = out.repartitionByRange(*cut, table.key)
    if order:
        out = out.sortWithinPartitions(*order)
    writer = out.write.mode(mode)
    if cut:
        writer = writer.partitionBy(*cut)
    writer.parquet(path)
