"""Which keys of a batch are in a large table: a stored filter first, an exact join after.

The filter is a Bloom filter whose bits lie in a table of bitmaps, 4 KB each. It is built with
partial aggregation, grows by OR, and is asked by a join on the bitmap's number. A key that it
does not know is surely absent; the exact join sees the few others only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_BITMAP = 32768
BITS_PER_KEY, HASHES = 12, 6


def filter_bits(keys: int) -> int:
    """The bits of a filter for so many keys, in whole bitmaps."""
    return max(1, -(-keys * BITS_PER_KEY // BITS_PER_BITMAP)) * BITS_PER_BITMAP


def _positions(column: str, bits: int) -> Column:
    one, two = F.xxhash64(column), F.xxhash64(column, F.lit(1))
    # products wrap around by hashing instead, since numbers here do not overflow
    return F.array(*[F.pmod(F.xxhash64(one, two, F.lit(k)), F.lit(bits)) for k in range(HASHES)])


def _placed(df: DataFrame, column: str, bits: int) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(
        "*", F.explode(_positions(column, bits)).alias("_at")
    ).withColumn("bucket", F.expr(f"_at div {BITS_PER_BITMAP}"))


def build_filter(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """The filter of a column: ``bucket``, ``bitmap``."""
    return _placed(keys.select(column), column, bits).groupBy("bucket").agg(
        F.bitmap_construct_agg(F.col("_at") % BITS_PER_BITMAP).alias("bitmap")
    )


def grown(stored: DataFrame, more: DataFrame) -> DataFrame:
    """The filter of both sets of keys; both have the same number of bits."""
    return stored.unionByName(more).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def maybe_present(batch: DataFrame, column: str, stored: DataFrame, bits: int) -> DataFrame:
    """The distinct keys of a batch that the filter may hold."""
    asked = _placed(batch.select(column).distinct(), column, bits)
    byte = F.expr(f"CAST(conv(hex(substring(bitmap, CAST(_at % {BITS_PER_BITMAP} AS INT) div 8 + 1, 1)), 16, 10) AS INT)")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, CAST(_at % 8 AS INT))")) != 0
    return (
        asked.join(stored, "bucket").where(is_set).groupBy(column).agg(F.count("*").alias("_n"))
        .where(F.col("_n") == HASHES).select(column)
    )
