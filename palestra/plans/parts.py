"""Joins that several views share. Small sides join each other first, so a large table
of visits, payments or bookings is shuffled once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palestra.asof import AsOf
from palestra.sources.tables import ClubTables


def user_names(t: ClubTables, *extra: str) -> DataFrame:
    return t["users"].select("userid", F.col("name").alias("user_name"), *extra)


def active_subscriptions(t: ClubTables) -> DataFrame:
    """At most one row per member."""
    return t["membersubscription"].where("isactive")


def member_profile(t: ClubTables) -> DataFrame:
    """Every member with user, active subscription and plan; one row per member."""
    subscription = active_subscriptions(t).select(
        "memberid", "subscriptionid", "planid", "startdate", "enddate",
        F.col("isactive").alias("subscription_active"),
    )
    plan = t["plan"].select(
        "planid", F.col("name").alias("plan_name"), "monthlyprice", "access24h"
    )
    return (
        t["member"]
        .join(subscription, "memberid", "left")
        .join(plan, "planid", "left")
        .join(user_names(t, "email"), "userid", "left")
    )


def member_users(t: ClubTables) -> DataFrame:
    return t["member"].select("memberid", "userid")


def member_names(t: ClubTables) -> DataFrame:
    """Members that have a user, with its name; as stored, where they are."""
    if "member_names" in t:
        return t["member_names"]
    return member_users(t).join(user_names(t), "userid")


def class_details(t: ClubTables, how: str, only_active: bool = False) -> DataFrame:
    """Classes with instructor and the instructor's name; one row per class."""
    classes = t["class"].where("isactive") if only_active else t["class"]
    return (
        classes.select(
            "classid", "instructorid", F.col("name").alias("class_name"), "room", "capacity",
            "duration_minutes",
        )
        .join(t["instructor"].select("instructorid", "userid"), "instructorid", how)
        .join(user_names(t), "userid", how)
        .withColumnRenamed("user_name", "instructor_name")
    )


def open_classes(
    t: ClubTables, as_of: AsOf, later_than: int | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """Today's active classes that have free spots; with ``later_than`` only those that
    start after that time of day. The large tables meet the day's schedules only. ``counts``
    (``classscheduleid``, ``booked``), if they are kept, stand for the bookings."""
    schedules = t["classschedule"].where(F.col("isactive") & (F.col("date") == as_of.today()))
    if later_than is not None:
        schedules = schedules.where(F.col("starttime") > F.lit(later_than))
    schedules = schedules.where(F.col("maxparticipants").isNotNull()).select(
        "classscheduleid", "classid", "date", "starttime", "endtime", "maxparticipants"
    )
    if counts is not None:
        booked = counts.select("classscheduleid", F.col("booked").alias("current_bookings"))
    else:
        booked = (
            t["classbooking"].select("classscheduleid")
            .join(schedules.select("classscheduleid"), "classscheduleid", "left_semi")
            .groupBy("classscheduleid").agg(F.count("*").alias("current_bookings"))
        )
    free = (
        schedules.join(booked, "classscheduleid", "left")
        .withColumn("current_bookings", F.coalesce("current_bookings", F.lit(0)))
        .withColumn("available_spots", F.col("maxparticipants") - F.col("current_bookings"))
        .where("available_spots > 0")
    )
    classes = t["class"].where("isactive").select(
        "classid", "instructorid", F.col("name").alias("class_name"), "room", "capacity",
        "duration_minutes",
    )
    return (
        free.join(classes, "classid")
        .join(t["instructor"].select("instructorid", "userid"), "instructorid")
        .join(user_names(t), "userid")
        .select(
            "classscheduleid", "class_name", "room", "capacity", "duration_minutes",
            F.col("user_name").alias("instructor_name"), "date", "starttime", "endtime",
            "maxparticipants", "current_bookings", "available_spots",
        )
    )


def newest_first(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_first() for c in columns]


def lowest_first(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]
