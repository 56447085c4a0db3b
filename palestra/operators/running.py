"""Numbers of bookings per schedule that are kept up to date by signed deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS_PER_RANGE = 1_000_000
_SCHEMA = "classscheduleid BIGINT, booked BIGINT, batch STRING, key_range BIGINT"


def booking_deltas(added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Per schedule by how much its bookings grow; pre-aggregated before the shuffle."""
    signed = [
        df.select("classscheduleid", F.lit(sign).alias("delta"))
        for df, sign in ((added, 1), (removed, -1))
        if df is not None
    ]
    rows = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    return rows.groupBy("classscheduleid").agg(F.sum("delta").cast("bigint").alias("delta"))


def counted(before: DataFrame, batch: str, deltas: DataFrame) -> DataFrame:
    """The counts after a batch. A count that carries the batch's name has its delta already,
    so the latest batch can be repeated."""
    new = deltas.select("classscheduleid", "delta")
    merged = before.select("classscheduleid", "booked", F.col("batch").alias("last")).join(
        new, "classscheduleid", "full_outer"
    )
    fresh = F.col("delta").isNotNull() & ~F.col("last").eqNullSafe(F.lit(batch))
    return merged.select(
        "classscheduleid",
        (F.coalesce("booked", F.lit(0)) + F.when(fresh, F.col("delta")).otherwise(0))
        .cast("bigint").alias("booked"),
        F.when(fresh, F.lit(batch)).otherwise(F.col("last")).alias("batch"),
    )


def read_counts(spark: SparkSession, root: str) -> DataFrame:
    """The stored counts: ``classscheduleid``, ``booked``, the last ``batch`` and the folder."""
    path = f"{root}/bookingcount"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(path)


def merge_counts(store, batch: str, deltas: DataFrame) -> None:
    """Bring the stored counts up to date. Only the folders of the batch's schedules are read
    and written, and no booking but the batch's own."""
    spark, range_ = store.spark, F.expr(f"classscheduleid div {KEYS_PER_RANGE}")
    placed = deltas.withColumn("key_range", range_)
    touched = [r[0] for r in placed.select("key_range").distinct().collect()]
    if not touched:
        return
    before = read_counts(spark, store.root).where(F.col("key_range").isin(touched))
    after = counted(before, batch, deltas).withColumn("key_range", range_)
    (
        after.repartitionByRange("key_range", "classscheduleid")
        .sortWithinPartitions("key_range", "classscheduleid")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("key_range").parquet(f"{store.root}/bookingcount")
    )
