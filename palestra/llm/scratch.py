"""Intermediate tables in the shared folder, and their removal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palestra.session import application_folder, delete_folder


class Scratch:
    """One run's folder below the application's, which goes when the application ends. A table
    in it cuts the lineage: lost executors cost no recomputation of what came before."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{application_folder(spark)}/llm-{uuid.uuid4().hex}"
        self._tables = 0

    def path(self, name: str) -> str:
        self._tables += 1
        return f"{self.folder}/{self._tables}-{name}"

    def table(self, df: DataFrame, name: str = "table", rows_at_once: int | None = None) -> DataFrame:
        """The stored rows. ``rows_at_once`` bounds the rows of a batch that goes to Python,
        for wide rows."""
        path = self.path(name)
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        usual = self.spark.conf.get(key)
        try:
            if rows_at_once:
                self.spark.conf.set(key, str(rows_at_once))
            df.write.parquet(path)
        finally:
            self.spark.conf.set(key, usual)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        own = self.folder.rpartition("/")[2]
        for table in tables:
            for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
                if own in path:
                    self.delete(path)

    def close(self) -> None:
        self.delete(self.folder)

    def delete(self, path: str) -> None:
        delete_folder(self.spark, path)
