"""Stored tables that take inserts, updates and deletes by rewriting only the partitions
that a batch touches.

Tables with dates lie in one folder per day, or per month where days are small; the others in
one per range of keys. A batch
finds the partitions of its keys, reads those, and overwrites them with Spark's dynamic
partition overwrite; the files of all others stay as they are. Every change is stated by key,
so a batch that is repeated after a failure leaves the same rows. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palestra.asof import AsOf
from palestra.operators.changes import update_rows
from palestra.operators.joins import ROWS_PER_TASK, Hint, by_key, fits, rows_for
from palestra.session import delete_folder, durable
from palestra.sources.schema import PARTITION_COLUMNS, SORT_COLUMNS, TABLES
from palestra.sources.seeds import SEED_ROWS, seed_table
from palestra.sources.tables import ClubTables

KEYS_PER_RANGE = 1_000_000


class StoredTables:
    """``unit`` is ``day`` or ``month``."""

    def __init__(
        self, spark: SparkSession, root: str, keys_per_range: int = KEYS_PER_RANGE, unit: str = "day"
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keys_per_range = keys_per_range
        self.unit = unit

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _cut(self, name: str) -> str:
        """The column that folders are named by."""
        date = PARTITION_COLUMNS.get(name)
        return "key_range" if date is None else date[0] if self.unit == "day" else "period"

    def _placed(self, df: DataFrame, name: str) -> DataFrame:
        """The table's columns in their types, and the column of the folder."""
        table = TABLES[name]
        out = df.select(*[df[c.name].cast(c.spark_type).alias(c.name) for c in table.columns])
        if self._cut(name) == "key_range":
            range_ = F.expr(f"CAST({table.key} AS BIGINT) div {self.keys_per_range}")
            out = out.withColumn("key_range", range_)
        elif self._cut(name) == "period":
            out = out.withColumn("period", F.trunc(PARTITION_COLUMNS[name][0], self.unit))
        return out

    def _beyond_session(self, rows: int) -> int:
        """``rows`` if they need more tasks than the session's shuffle partitions, else 0:
        below that the session's own plan stays as it is."""
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows if -(-rows // ROWS_PER_TASK) > least else 0

    def _spread(self, df: DataFrame, key: str, rows: int) -> DataFrame:
        """The frame hashed by key over partitions that follow ``rows``; unchanged for none."""
        return by_key(df, key, rows) if rows else df

    def _write(
        self, placed: DataFrame, name: str, mode: str, only_touched: bool = False, n_rows: int = 0
    ) -> None:
        """``n_rows``, if known, sets how many ranges the rows are cut into, so that one task's
        share does not grow with the table."""
        cut, table = self._cut(name), TABLES[name]
        ranges = [-(-n_rows // ROWS_PER_TASK)] if n_rows else []
        rows = placed.repartitionByRange(*ranges, cut, table.key).sortWithinPartitions(
            cut, *SORT_COLUMNS.get(name, []), table.key
        )
        writer = rows.write.mode(mode).partitionBy(cut)
        if only_touched:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.parquet(self.path(name))

    def _stored(self, name: str) -> DataFrame:
        """The rows with the column of the folder; none if the table was never written."""
        schema, cut = TABLES[name].struct, self._cut(name)
        if cut not in schema.names:
            kind = T.LongType() if cut == "key_range" else T.DateType()
            schema = T.StructType([*schema.fields, T.StructField(cut, kind)])
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name)).select(*schema.names)

    def read(self, name: str) -> DataFrame:
        return self._stored(name).select(*TABLES[name].names)

    def tables(self) -> ClubTables:
        return ClubTables(self.spark, {name: (lambda name=name: self.read(name)) for name in TABLES})

    def create(self, name: str, rows: DataFrame | None = None) -> None:
        """Drop the table, if it is there, and create it with the given rows or none."""
        delete_folder(self.spark, self.path(name))
        empty = self.spark.createDataFrame([], TABLES[name].struct)
        self._write(self._placed(empty if rows is None else rows, name), name, "overwrite")

    def create_all(self, as_of: AsOf) -> None:
        """Drop and re-create all tables, empty but for the first rows of the lookup tables."""
        for name in TABLES:
            self.create(name, seed_table(self.spark, name, as_of) if name in SEED_ROWS else None)

    def insert(self, name: str, rows: DataFrame) -> None:
        """Add rows with new keys; no stored file is read or changed."""
        self._write(self._placed(rows, name), name, "append")

    def merge(
        self, name: str, rows: DataFrame | None = None, gone: DataFrame | None = None
    ) -> None:
        """Rows take the place of stored ones with their key or are added; keys in ``gone`` go.

        Only the folders that hold one of the keys, or will, are read and written. The driver
        learns the names of these folders, which Spark's listing of the table holds as well.
        """
        table, cut = TABLES[name], self._cut(name)
        key = table.key
        new = self._placed(
            self.spark.createDataFrame([], table.struct) if rows is None else rows, name
        )
        keys = new.select(key)
        if gone is not None:
            keys = keys.unionByName(gone.select(F.col(gone.columns[0]).cast(keys.schema[key].dataType).alias(key)))
        keys = keys.distinct()
        hint = Hint(fits(keys))
        stored = self._stored(name)
        # past a broadcast, both sides of each join are hashed alike over partitions that
        # follow the stored rows (a count parquet answers from its footers)
        stored_rows = 0 if hint.small else self._beyond_session(stored.count())
        keys = self._spread(keys, key, stored_rows)
        before = rows_for(self._spread(stored.select(key, cut), key, stored_rows), keys, [key], hint).select(cut)
        touched = [r[0] for r in before.unionByName(new.select(cut)).distinct().collect()]
        if not touched:
            return
        kept = self._spread(stored.where(F.col(cut).isin(touched)), key, stored_rows).join(
            hint(keys), key, "left_anti"
        )
        after = kept.unionByName(new)
        filled = {r[0] for r in after.select(cut).distinct().collect()}
        if filled:
            self._write(after, name, "overwrite", only_touched=True, n_rows=stored_rows)
        for value in touched:  # a folder without rows is not overwritten
            if value not in filled:
                delete_folder(self.spark, f"{self.path(name)}/{cut}={value}")

    def update(self, name: str, changes: DataFrame, as_of: AsOf) -> DataFrame:
        """Give stored rows new values by key, and ``updated_at``. Returns the changes whose
        key is unknown."""
        key = TABLES[name].key
        hint = Hint(fits(changes))
        stored = self.read(name)
        # past a broadcast, the joins are hashed by key over partitions that follow the rows
        rows = 0 if hint.small else self._beyond_session(stored.count())
        changes = self._spread(changes, key, rows)
        found = self._spread(rows_for(self._spread(stored, key, rows), changes, [key], hint), key, rows)
        after, _ = update_rows(found, key, changes, as_of)
        # stored before the files it is found by are replaced
        unknown = durable(changes.join(found.select(key), key, "left_anti"))
        self.merge(name, after)
        return unknown
