"""Intake of class bookings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palestra.asof import AsOf
from palestra.operators.changes import with_defaults
from palestra.operators.joins import Hint, beyond_session, fits, not_held_once, side_for
from palestra.operators.numbering import highest_key, numbered
from palestra.plans.parts import member_users
from palestra.session import durable
from palestra.sources.tables import ClubTables

MEMBER_UNKNOWN = "Member not found for user ID "
SCHEDULE_UNKNOWN = "Class schedule not found"
ALREADY_BOOKED = "This class is already booked for this member"


@dataclass(frozen=True)
class Bookings:
    classbooking: DataFrame
    rejects: DataFrame


def _outcomes(known: str, held: str) -> Column:
    """One row per row in store, TRUE for each known one; FALSE where there is none."""
    n, copies = (F.coalesce(c, F.lit(0)).cast("int") for c in (known, held))
    unknown = F.greatest(copies, F.lit(1)) - n
    return F.explode(F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), unknown)))


def book_classes(t: ClubTables, as_of: AsOf, requests: DataFrame) -> Bookings:
    """Take in booking requests (``request_id``, ``userid``, ``classscheduleid``,
    ``requested_at``) in the order of their time.

    Places, date and activity of the class are not checked: a class can be overbooked.
    """
    n_rows = requests.count()
    arrivals = numbered(
        requests, ["requested_at", "request_id", "userid", "classscheduleid"], "arrival", n_rows
    )
    # users and schedules are unique in store, so a small batch finds few of them
    hint = Hint(fits(arrivals))
    # past the session's partitions, the joins are hashed over as many as the requests need
    tasks = beyond_session(requests.sparkSession, n_rows)

    def spread(df: DataFrame, *key: str) -> DataFrame:
        return df.repartition(tasks, *key) if tasks else df

    members = spread(side_for(member_users(t), arrivals, ["userid"], hint), "userid")
    schedules = side_for(
        t["classschedule"].select("classscheduleid"), arrivals, ["classscheduleid"], hint
    )
    # a schedule is looked up once for all its requests; only those that are unknown, or in
    # store more than once, go on to the requests
    odd_schedules = durable(
        not_held_once(
            spread(arrivals.select("classscheduleid"), "classscheduleid"),
            spread(schedules, "classscheduleid"), "classscheduleid", hint,
        )
    )
    few = Hint(fits(odd_schedules))
    # the requests are stored once, by their number, and meet the users without their other
    # fields; those are shuffled once, to the outcome
    possible = (
        spread(arrivals.where("classscheduleid IS NOT NULL").drop("request_id"), "userid")
        .join(hint(members.where("memberid IS NOT NULL")), "userid")
        .join(few(odd_schedules.where("held = 0")), "classscheduleid", "left_anti")
    )
    # the earliest request of each pair, pre-aggregated, then without the pairs in store
    pair = ["memberid", "classscheduleid"]
    earliest = [
        F.min_by("requested_at", "arrival").alias("requested_at"), F.min("arrival").alias("arrival")
    ]
    if tasks:  # hashed by user already, so this needs no shuffle
        possible = possible.groupBy("userid", *pair).agg(*earliest)
    first = spread(possible, *pair).groupBy(*pair).agg(*earliest)
    held = t["classbooking"].select("bookingid", *pair)
    if not hint.small:  # read twice below
        held = durable(held, codec="zstd")
    stored = spread(side_for(held.select(*pair), first, pair, hint), *pair)
    accepted = durable(first.join(hint(stored), pair, "left_anti"), codec="zstd")
    # what a request is not assumed to have: one member and one schedule
    found = members.groupBy("userid").agg(
        F.count("memberid").alias("known"), F.count("*").alias("held")
    )
    odd_members = (
        spread(arrivals.select("arrival", "userid"), "userid").join(hint(found), "userid", "left")
        .where("held IS NULL OR held <> 1 OR known <> 1")
        .select("arrival", _outcomes("known", "held").alias("member_known"))
    )
    rejects = (
        spread(arrivals, "arrival")
        .join(hint(spread(accepted.select("arrival"), "arrival")), "arrival", "left_anti")
        .join(hint(spread(odd_members, "arrival")), "arrival", "left")
        .join(
            few(odd_schedules.select(
                "classscheduleid", _outcomes("held", "held").alias("schedule_known"))),
            "classscheduleid", "left",
        )
        .select(
            "request_id", "userid", "classscheduleid", "requested_at",
            F.when(
                ~F.col("member_known"),
                F.concat_ws("", F.lit(MEMBER_UNKNOWN), F.col("userid").cast("string")),
            )
            .when(F.col("classscheduleid").isNull() | ~F.col("schedule_known"), F.lit(SCHEDULE_UNKNOWN))
            .otherwise(F.lit(ALREADY_BOOKED)).alias("reason"),
        )
    )
    # as with a sequence, a rejected request leaves a gap in the keys
    rows = accepted.select(
        (F.col("arrival") + highest_key(held, "bookingid")).alias("bookingid"),
        *pair, F.col("requested_at").alias("bookingdate"),
    )
    return Bookings(with_defaults(rows, "classbooking", as_of), rejects)
