"""Figures per day that merge into those of longer spans without reading the rows again.

A visit and a booking belong to one day, so their counts per member add up over days. Who
came is no count that adds up: each day keeps bitmaps of its visitors, one for every 32,768
member numbers, and a span is their OR. Both are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palestra.asof import AsOf
from palestra.functions.clock import total_length
from palestra.sources.tables import ClubTables


def member_days(t: ClubTables) -> DataFrame:
    """Per member and day: visits, the time stayed and bookings made."""
    visits = t["checkin"].select(
        "memberid", F.col("date").alias("day"), (F.col("exittime") - F.col("entrancetime")).alias("stay"),
        F.lit(1).alias("visit"), F.lit(0).alias("booking"),
    )
    bookings = t["classbooking"].select(
        "memberid", F.to_date("bookingdate").alias("day"), F.lit(None).cast("bigint").alias("stay"),
        F.lit(0).alias("visit"), F.lit(1).alias("booking"),
    )
    return visits.unionByName(bookings).groupBy("memberid", "day").agg(
        F.sum("visit").alias("visits"), total_length(F.col("stay")).alias("stay_us"), F.sum("booking").alias("bookings")
    )


def month_of_days(t: ClubTables, days: DataFrame, as_of: AsOf) -> tuple[DataFrame, DataFrame]:
    """Visits and bookings per member this month: whole days merged, and today's rows up to
    now, which are the only ones read."""
    past = days.where((F.col("day") >= as_of.month_start()) & (F.col("day") < as_of.today()))
    today = t.with_tables(
        checkin=t["checkin"].where(F.col("date") == as_of.today()),
        classbooking=t["classbooking"].where(
            F.col("bookingdate").between(as_of.today().cast("timestamp_ntz"), as_of.timestamp())
        ),
    )
    both = past.unionByName(member_days(today)).groupBy("memberid").agg(
        F.sum("visits").alias("checkins"), F.sum("stay_us").alias("stay_us"), F.sum("bookings").alias("bookings")
    )
    return both.select("memberid", "checkins", "stay_us"), both.select("memberid", "bookings")


def daily_visitors(t: ClubTables) -> DataFrame:
    """Per day the bitmaps of the members who came."""
    return t["checkin"].groupBy(
        F.col("date").alias("day"), F.bitmap_bucket_number("memberid").alias("bucket")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("memberid")).alias("members"))


def month_visitors(daily: DataFrame) -> DataFrame:
    """Different members who came per month, from the bitmaps of its days."""
    months = daily.groupBy(F.trunc("day", "MM").alias("month"), "bucket").agg(F.bitmap_or_agg("members").alias("members"))
    return months.groupBy("month").agg(F.sum(F.bitmap_count("members")).alias("visitors"))
