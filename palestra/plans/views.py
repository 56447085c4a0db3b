"""The club's named views. Each takes the tables and the clock and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palestra.asof import AsOf
from palestra.functions.clock import hours, stay_text, total_length
from palestra.functions.display import STILL_INSIDE, payment_status
from palestra.operators.joins import split_left_join
from palestra.plans.member_days import month_of_days
from palestra.plans.parts import (
    active_subscriptions,
    class_details,
    lowest_first,
    member_names,
    member_profile,
    member_users,
    newest_first,
    open_classes,
    user_names,
)
from palestra.sources.tables import ClubTables


def user_authentication(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Active users with the label of their type."""
    types = t["usertype"].select("usertypeid", F.col("label").alias("user_type_label"))
    return (
        t["users"].where("isactive")
        .join(types, "usertypeid")
        .select("userid", "email", "name", "password", "usertypeid", "isactive", "user_type_label")
    )


def email_exists(t: ClubTables, as_of: AsOf) -> DataFrame:
    return t["users"].select("userid", "email")


def plan_choices(t: ClubTables, as_of: AsOf) -> DataFrame:
    return t["plan"].select("planid", "name", "monthlyprice", "access24h")


def member_data(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Active members with user, active subscription and plan."""
    active = t.with_tables(member=t["member"].where("isactive"))
    return member_profile(active).select(
        "memberid", F.col("user_name").alias("name"), "email", "registrationdate",
        "subscriptionid", "startdate", "enddate", "subscription_active", "plan_name",
        "monthlyprice", "userid",
    )


def _month_rows(t: ClubTables, as_of: AsOf) -> tuple[DataFrame, DataFrame]:
    """Visits and bookings per member this month."""
    visits = (
        t["checkin"].where(F.col("date").between(as_of.month_start(), as_of.today()))
        .groupBy("memberid")
        .agg(
            F.count("*").alias("checkins"),
            total_length(F.col("exittime") - F.col("entrancetime")).alias("stay_us"),
        )
    )
    bookings = (
        t["classbooking"]
        .where(F.col("bookingdate").between(as_of.month_start_timestamp(), as_of.timestamp()))
        .groupBy("memberid")
        .agg(F.count("*").alias("bookings"))
    )
    return visits, bookings


def _month_activity(t: ClubTables, as_of: AsOf, days: DataFrame | None = None) -> DataFrame:
    """One row per active member: this month's visits, bookings and unpaid payments, each
    aggregated on its own side, so the sides never multiply each other's rows."""
    visits, bookings = month_of_days(t, days, as_of) if days is not None else _month_rows(t, as_of)
    unpaid = (
        t["payment"].where(~F.col("ispayed") & (F.col("duedate") >= as_of.month_start()))
        .groupBy("subscriptionid")
        .agg(F.count("*").alias("unpaid"), F.min("duedate").alias("next_payment"))
    )
    prices = t["plan"].select("planid", F.col("monthlyprice").alias("payment_price"))
    due = (
        active_subscriptions(t).select("memberid", "subscriptionid", "planid")
        .join(unpaid, "subscriptionid", "left")
        .join(prices, "planid", "left")
    )
    return (
        t["member"].where("isactive").select("memberid", "userid")
        .join(visits, "memberid", "left")
        .join(bookings, "memberid", "left")
        .join(due, "memberid", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("checkins", "bookings", "unpaid")})
    )


def _month_columns(total_us) -> list:
    return [
        F.col("checkins").alias("checkin_count"),
        F.col("bookings").alias("class_bookings"),
        hours(total_us).alias("total_hours"),
        "next_payment", "payment_price", "memberid", "userid",
    ]


def member_stats_month(t: ClubTables, as_of: AsOf, days: DataFrame | None = None) -> DataFrame:
    """Month to date per active member. As defined, a visit's hours count once for every
    pair of the member's bookings and unpaid payments. ``days`` are figures per day, kept as
    ``plans/member_days.py`` makes them."""
    times = F.greatest("bookings", F.lit(1)) * F.greatest("unpaid", F.lit(1))
    return _month_activity(t, as_of, days).select(*_month_columns(F.col("stay_us") * times))


def member_stats_month_corrected(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Month to date per active member, each visit's hours counted once."""
    return _month_activity(t, as_of).select(*_month_columns(F.col("stay_us")))


def schedule_bookings(t: ClubTables, as_of: AsOf) -> tuple[DataFrame, DataFrame]:
    """Active classes from today on: one row per booking, and those nobody booked."""
    schedules = (
        t["classschedule"].where(F.col("isactive") & (F.col("date") >= as_of.today()))
        .select("classscheduleid", "classid", "date", "starttime", "endtime")
        .join(class_details(t, "left").drop("userid"), "classid", "left")
    )
    bookings = t["classbooking"].select("classscheduleid", "memberid")
    booked, unbooked = split_left_join(schedules, bookings, "classscheduleid")
    return booked.join(member_users(t), "memberid", "left"), unbooked


_SCHEDULE_COLUMNS = ["class_name", "date", "starttime", "endtime", "room", "instructor_name"]


def member_schedule_classes(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Active classes from today on, one row per booking; a class nobody booked has one
    row without user."""
    booked, unbooked = schedule_bookings(t, as_of)
    no_user = F.lit(None).cast("bigint").alias("userid")
    return booked.select(*_SCHEDULE_COLUMNS, "userid").unionByName(
        unbooked.select(*_SCHEDULE_COLUMNS, no_user)
    )


def member_available_classes(
    t: ClubTables, as_of: AsOf, counts: DataFrame | None = None
) -> DataFrame:
    """Today's active classes that start later than now and have free spots. ``counts`` are
    numbers of bookings that are kept up to date (``operators/running.py``)."""
    return open_classes(t, as_of, later_than=as_of.time_us, counts=counts)


def member_account_details(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Member profiles, one row per unpaid payment due today or later, at least one each."""
    upcoming = (
        t["payment"].where(~F.col("ispayed") & (F.col("duedate") >= as_of.today()))
        .select("subscriptionid", F.col("duedate").alias("next_payment_date"))
    )
    due, nothing_due = split_left_join(member_profile(t), upcoming, "subscriptionid")
    return due.unionByName(nothing_due, allowMissingColumns=True).select(
        "memberid", F.col("user_name").alias("name"), "nif", "email", "phone", "iban",
        "birthdate", "gender", "address", "city", "postalcode", "registrationdate",
        "startdate", "enddate", "next_payment_date", "plan_name", "monthlyprice", "access24h",
        "userid",
    )


def instructor_info(t: ClubTables, as_of: AsOf) -> DataFrame:
    return (
        t["instructor"].join(user_names(t, "email"), "userid", "left")
        .select("instructorid", F.col("user_name").alias("name"), "nif", "email", "phone",
                "isactive", "userid")
    )


def instructor_classes(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Active classes with their instructor's user."""
    return (
        t["class"].where("isactive")
        .join(t["instructor"].select("instructorid", "userid"), "instructorid")
        .select("classid", "name", "room", "capacity", "duration_minutes", "instructorid", "userid")
    )


def class_schedules(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Active schedules with class and instructor."""
    classes = t["class"].select("classid", "name", "room", "instructorid").join(
        t["instructor"].select("instructorid", "userid"), "instructorid"
    )
    return (
        t["classschedule"].where("isactive").join(classes, "classid")
        .select("classscheduleid", "name", "date", "starttime", "endtime", "maxparticipants",
                "room", "instructorid", "userid")
    )


def dashboard_stats(t: ClubTables, as_of: AsOf) -> DataFrame:
    """One row of counters."""
    counted = {
        "total_members": t["member"].where("isactive"),
        "total_instructors": t["instructor"].where("isactive"),
        "active_memberships": t["membersubscription"].where("isactive"),
        "today_checkins": t["checkin"].where(F.col("date") == as_of.today()),
    }
    rows = None
    for name, df in counted.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(
        *[F.sum(F.when(F.col("counter") == name, F.col("n"))).alias(name) for name in counted]
    )


def all_members(t: ClubTables, as_of: AsOf) -> DataFrame:
    return member_profile(t).select(
        "memberid", F.col("user_name").alias("name"), "email", "phone", "registrationdate",
        "isactive", "startdate", "enddate", "plan_name",
    )


def all_classes(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Active schedules with the names of class and instructor."""
    return (
        t["classschedule"].where("isactive").join(class_details(t, "inner"), "classid")
        .select("classscheduleid", F.col("class_name").alias("name"), "instructor_name", "date",
                "starttime", "endtime", "room", "maxparticipants")
    )


def all_checkins(t: ClubTables, as_of: AsOf) -> DataFrame:
    return (
        t["checkin"].join(member_names(t), "memberid")
        .select("checkinid", F.col("user_name").alias("name"), "date", "entrancetime", "exittime")
    )


def machines(t: ClubTables, as_of: AsOf) -> DataFrame:
    return (
        t["machine"].join(t["machinestatus"].select("machinestatusid", "status"), "machinestatusid")
        .select("machineid", "name", "type", "manufacturer", "model", "status",
                "installationdate", "maintenancedate")
    )


def payers(t: ClubTables) -> DataFrame:
    """Subscriptions with member, member's name and plan; as stored, where they are."""
    if "payers" in t:
        return t["payers"]
    return (
        t["membersubscription"].select("subscriptionid", "memberid", "planid")
        .join(member_names(t), "memberid")
        .join(t["plan"].select("planid", F.col("name").alias("plan_name")), "planid")
        .select("subscriptionid", "memberid", F.col("user_name").alias("member_name"), "plan_name")
    )


def payment_rows(t: ClubTables) -> DataFrame:
    """Payments with member, member's name and plan."""
    return t["payment"].join(payers(t), "subscriptionid")


_PAYMENT_COLUMNS = [
    "paymentid", "member_name", "plan_name", "amount", "duedate", "paymentdate", "ispayed",
    "paymentmethod",
]


def payments(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Payments with the names of member and plan."""
    return payment_rows(t).select(*_PAYMENT_COLUMNS)


def payments_with_state(t: ClubTables, as_of: AsOf) -> DataFrame:
    """The same with the payment's state and its member."""
    status = payment_status(F.col("ispayed"), F.col("duedate"), as_of.today())
    return payment_rows(t).select(*_PAYMENT_COLUMNS, status.alias("payment_status"), "memberid")


def plans(t: ClubTables, as_of: AsOf) -> DataFrame:
    return t["plan"].select(
        "planid", "name", "monthlyprice", "access24h", "description", "isactive"
    )


def payment_history_rows(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Payments with their state and the member they belong to."""
    payers = (
        t["membersubscription"].select("subscriptionid", "memberid")
        .join(member_users(t), "memberid")
    )
    status = payment_status(F.col("ispayed"), F.col("duedate"), as_of.today())
    return (
        t["payment"].join(payers, "subscriptionid")
        .select("paymentid", F.col("duedate").alias("payment_date"),
                F.col("amount").alias("payment_amount"), "paymentmethod",
                status.alias("payment_status"), "paymentdate", "memberid", "userid")
    )


def member_payment_history(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Payment history, newest due date first. The key ends the sort, so a date that many
    payments share is still cut over several tasks."""
    return payment_history_rows(t, as_of).orderBy(
        *newest_first("payment_date"), *lowest_first("paymentid")
    )


def checkin_history_rows(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Visits with their length as a number and as text."""
    stay = F.col("exittime") - F.col("entrancetime")
    return (
        t["checkin"].join(member_users(t), "memberid")
        .select("checkinid", F.col("date").alias("checkin_date"), "entrancetime", "exittime",
                hours(stay).alias("duration_hours"),
                F.coalesce(stay_text(stay), F.lit(STILL_INSIDE)).alias("duration_formatted"),
                "memberid", "userid")
    )


def member_checkin_history(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Visit history, newest first."""
    return checkin_history_rows(t, as_of).orderBy(
        *newest_first("checkin_date", "entrancetime"), *lowest_first("checkinid")
    )


VIEWS = {
    "user_authentication": user_authentication,
    "email_exists": email_exists,
    "plan": plan_choices,
    "member_data": member_data,
    "member_stats_month": member_stats_month,
    "member_schedule_classes": member_schedule_classes,
    "member_available_classes": member_available_classes,
    "member_account_details": member_account_details,
    "instructor_info": instructor_info,
    "instructor_classes": instructor_classes,
    "class_schedules": class_schedules,
    "dashboard_stats": dashboard_stats,
    "all_members": all_members,
    "all_classes": all_classes,
    "all_checkins": all_checkins,
    "machines": machines,
    "payments": payments,
    "plans": plans,
    "member_payment_history": member_payment_history,
    "member_checkin_history": member_checkin_history,
}


def register_views(t: ClubTables, as_of: AsOf) -> None:
    """Make every view readable as ``vw_<name>`` in ``spark.sql``, replacing older ones."""
    for name, view in VIEWS.items():
        view(t, as_of).createOrReplaceTempView(f"vw_{name}")
