"""Texts that contain a text, by postings of their one, two and three letter parts.

The scan reads every text for each question. The postings name, for each part, the rows whose
texts hold it; a question reads the postings of its own parts, keeps the rows that hold all of
them, and verifies only those. A question of one or two letters is a part itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
FOLDERS = 64
_SCHEMA = "gram STRING, column STRING, row_id BIGINT, folder INT"


def _grams(text: Column, size: int) -> Column:
    """The parts of one size; none of a text that is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(
        F.length(text) >= size, F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def _tagged(column: str):
    """A part with the name of its column (one argument: ``transform`` passes an index to two)."""
    return lambda gram: F.struct(gram.alias("gram"), F.lit(column).alias("column"))


def postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row per part, column and row of the table. Case does not count; a NULL has no parts.
    One pass over the rows makes the parts of all columns."""
    held = "array<struct<gram:string,column:string>>"
    per_column = []
    for c in columns:
        text = F.lower(F.col(c).cast("string"))
        parts = F.array_distinct(F.concat(*[_grams(text, size) for size in range(1, GRAM + 1)]))
        per_column.append(F.when(F.col(c).isNotNull(), F.transform(parts, _tagged(c))).otherwise(
            F.array().cast(held)
        ))
    found = df.select(
        F.explode(F.concat(*per_column)).alias("part"), F.col(key).cast("bigint").alias("row_id")
    ).select("part.gram", "part.column", "row_id")
    return found.withColumn("folder", _folder(F.col("gram")))


def write_postings(df: DataFrame, key: str, columns: list[str], path: str, mode: str = "overwrite") -> None:
    """Store the postings by part. The table's rows, not their many parts, are spread over the
    tasks; each task sorts its own parts, so a part that most texts hold is spread over many
    files, and a file's row groups follow the parts. New rows of the table are added with mode
    ``append``."""
    sorted_postings(df, key, columns).write.mode(mode).partitionBy("folder").parquet(path)


def sorted_postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The postings as they are stored: the rows are shuffled, each task sorts its parts."""
    spark = df.sparkSession
    # A number of tasks of its own: rows are few, their parts many, so they are not coalesced.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = df.select(key, *columns).repartition(tasks, key, *columns)
    return postings(rows, key, columns).sortWithinPartitions("folder", "gram", "row_id")


def candidates(spark: SparkSession, path: str, text: str, columns: list[str]) -> DataFrame:
    """The keys (``row_id``) of rows of which one column holds all parts of the text. Reads the
    folders and row groups of these parts only."""
    low = text.lower()
    parts = sorted({low[i : i + GRAM] for i in range(max(1, len(low) - GRAM + 1))})
    folders = [r[0] for r in spark.createDataFrame([(p,) for p in parts], "gram STRING").select(_folder(F.col("gram"))).distinct().collect()]
    read = spark.read.schema(_SCHEMA).parquet(path).where(
        F.col("folder").isin(folders) & F.col("gram").isin(parts) & F.col("column").isin(columns)
    )
    holders = read.groupBy("row_id", "column").agg(F.count("*").alias("n"))
    return holders.where(F.col("n") == len(parts)).select("row_id").distinct()
