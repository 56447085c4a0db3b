"""Figures that the manager's and the instructor's screens show.

The screens hold fixed text in their place, so the formulas are this library's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palestra.asof import AsOf
from palestra.functions.clock import MICROS_PER_MINUTE, clock_text, hours, total_length, whole_hours
from palestra.functions.display import OVERDUE, PENDING
from palestra.operators.ranking import first_per_group
from palestra.operators.text_index import candidates
from palestra.plans import views
from palestra.plans.parts import active_subscriptions, lowest_first
from palestra.sources.tables import ClubTables

HALF_HOUR = 30 * MICROS_PER_MINUTE
TOTAL = "Total"


def _percent(part: Column, whole: Column) -> Column:
    """A share in percent, NULL where there is no whole."""
    ratio = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return ratio * F.lit(100.0)


def monthly_revenue(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Money received per month, with the change to the calendar month before."""
    months = (
        t["payment"].where("ispayed AND paymentdate IS NOT NULL")
        .groupBy(F.trunc("paymentdate", "month").alias("month"))
        .agg(F.sum("amount").alias("revenue"))
    )
    before = months.select(
        F.add_months("month", 1).alias("month"), F.col("revenue").alias("revenue_before")
    )
    change = F.col("revenue") - F.col("revenue_before")
    return months.join(before, "month", "left").withColumn(
        "change_percent", _percent(change, F.col("revenue_before"))
    )


def payment_states(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Payments made today, pending and overdue: sum, number and members."""
    status = F.col("payment_status")
    states = F.array(
        F.when(F.col("paymentdate") == as_of.today(), F.lit("Hoje")),
        F.when(status.isin(PENDING, OVERDUE), status),
    )
    return (
        views.payment_history_rows(t, as_of)
        .select(F.explode(F.array_compact(states)).alias("state"), "payment_amount", "memberid")
        .groupBy("state")
        .agg(
            F.sum("payment_amount").alias("amount"),
            F.count("*").alias("payments"),
            F.countDistinct("memberid").alias("members"),
        )
    )


def visits_today(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Today's visits, the change to yesterday, and visitors still inside."""
    today, yesterday = as_of.today(), F.date_sub(as_of.today(), 1)
    is_today = F.col("date") == today
    return (
        t["checkin"].where(F.col("date").between(yesterday, today))
        .agg(
            F.count_if(is_today).alias("checkins"),
            (F.count_if(is_today) - F.count_if(~is_today)).alias("change"),
            F.count_if(is_today & F.col("exittime").isNull()).alias("inside"),
        )
    )


def busiest_half_hours(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Per day, the half hour with the most arrivals; the earlier one on a tie."""
    slot = F.col("entrancetime") - F.col("entrancetime") % HALF_HOUR
    counts = t["checkin"].groupBy("date", slot.alias("slot")).agg(F.count("*").alias("checkins"))
    order = [F.col("checkins").desc(), *lowest_first("slot")]
    return first_per_group(counts, "date", order, 1).select(
        "date", clock_text(F.col("slot")).alias("half_hour"), "checkins"
    )


def _plan_members(t: ClubTables) -> DataFrame:
    """Active subscriptions of active members, with their plan."""
    active = t["member"].where("isactive").select("memberid")
    plan = t["plan"].select("planid", F.col("name").alias("plan_name"), "monthlyprice")
    return (
        active_subscriptions(t).select("memberid", "planid", "startdate")
        .join(active, "memberid", "left_semi")
        .join(plan, "planid")
    )


def _total(count: str):
    """The sum over the counted groups, of which there are few."""
    return F.sum(count).over(Window.partitionBy(F.lit(0)))


def members_per_plan(t: ClubTables, as_of: AsOf) -> DataFrame:
    counts = _plan_members(t).groupBy("plan_name").agg(F.count("*").alias("members"))
    return counts.withColumn("share", _percent(F.col("members"), _total("members")))


def plan_performance(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Members, new members of the month and monthly income per plan, and their total."""
    new = F.col("startdate").between(as_of.month_start(), as_of.today())
    return (
        _plan_members(t).rollup("plan_name")
        .agg(
            F.grouping("plan_name").alias("_total"),
            F.min("monthlyprice").alias("price"),
            F.count("*").alias("members"),
            F.count_if(new).alias("new_members"),
            F.sum("monthlyprice").alias("monthly_income"),
        )
        .select(
            F.when(F.col("_total") == 1, F.lit(TOTAL)).otherwise(F.col("plan_name")).alias("plan"),
            F.when(F.col("_total") == 0, F.col("price")).alias("price"),
            "members", "new_members", "monthly_income",
        )
    )


def machines_per_status(t: ClubTables, as_of: AsOf) -> DataFrame:
    counts = views.machines(t, as_of).groupBy("status").agg(F.count("*").alias("machines"))
    return counts.withColumn("share", _percent(F.col("machines"), _total("machines")))


def class_grid_cells(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Enrolled and places per day, hour and room, for the active classes from today on."""
    schedules = t["classschedule"].where(F.col("isactive") & (F.col("date") >= as_of.today()))
    booked = (
        t["classbooking"].join(schedules.select("classscheduleid"), "classscheduleid", "left_semi")
        .groupBy("classscheduleid").agg(F.count("*").alias("booked"))
    )
    return (
        schedules.join(booked, "classscheduleid", "left")
        .join(t["class"].select("classid", "room"), "classid")
        .groupBy("date", whole_hours(F.col("starttime")).alias("hour"), "room")
        .agg(
            F.coalesce(F.sum("booked"), F.lit(0)).alias("enrolled"),
            F.sum("maxparticipants").alias("places"),
        )
    )


def class_grid(t: ClubTables, as_of: AsOf, rooms: list[str]) -> DataFrame:
    """Today's grid: one row per hour, one column per room, cells such as ``8/15``."""
    cell = F.concat_ws("/", F.col("enrolled").cast("string"), F.col("places").cast("string"))
    return (
        class_grid_cells(t, as_of).where(F.col("date") == as_of.today())
        .groupBy("hour").pivot("room", rooms).agg(F.first(cell)).orderBy("hour")
    )


def instructor_month(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Per instructor this month: classes, hours, bookings, people and occupancy."""
    next_month = F.add_months(as_of.month_start(), 1)
    classes = (
        t["classschedule"]
        .where(F.col("isactive") & (F.col("date") >= as_of.month_start())
               & (F.col("date") < next_month))
        .join(t["class"].select("classid", "instructorid"), "classid")
        .select("classscheduleid", "instructorid", "maxparticipants",
                (F.col("endtime") - F.col("starttime")).alias("length_us"))
    )
    taught = classes.groupBy("instructorid").agg(
        F.count("*").alias("classes"),
        hours(total_length(F.col("length_us"))).alias("hours"),
        F.sum("maxparticipants").alias("places"),
    )
    people = (
        t["classbooking"].select("classscheduleid", "memberid")
        .join(classes.select("classscheduleid", "instructorid"), "classscheduleid")
        .groupBy("instructorid")
        .agg(F.count("*").alias("bookings"), F.countDistinct("memberid").alias("people"))
    )
    return taught.join(people, "instructorid", "left").select(
        "instructorid", "classes", "hours",
        F.coalesce("bookings", F.lit(0)).alias("bookings"),
        F.coalesce("people", F.lit(0)).alias("people"),
        _percent(F.coalesce("bookings", F.lit(0)), F.col("places")).alias("occupancy"),
    )


def _contains(text: str, *columns: str) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(
            F.contains(F.lower(F.col(c).cast("string")), F.lower(F.lit(text))), F.lit(False)
        )
    return found


def find_members(
    t: ClubTables, as_of: AsOf, text: str | None = None, active: bool | None = None,
    plan: str | None = None, index: str | None = None,
) -> DataFrame:
    """Members by a part of name or email, by activity and by plan. ``index`` names stored
    postings of the users' names and emails; then only users that hold the parts are read on."""
    if text and index:
        found = candidates(t.spark, index, text, ["name", "email"])
        named = found.select(F.col("row_id").alias("userid"))
        t = t.with_tables(
            member=t["member"].join(named, "userid", "left_semi"),
            users=t["users"].join(named, "userid", "left_semi"),
        )
    rows = views.all_members(t, as_of)
    if text:
        rows = rows.where(_contains(text, "name", "email"))
    if active is not None:
        rows = rows.where(F.col("isactive") == F.lit(active))
    if plan:
        rows = rows.where(F.col("plan_name") == F.lit(plan))
    return rows


def find_payments(
    t: ClubTables, as_of: AsOf, text: str | None = None, status: str | None = None,
    plan: str | None = None, since=None, until=None,
) -> DataFrame:
    """Payments with their state, by payer's name, state, plan and due date."""
    rows = views.payments_with_state(t, as_of)
    if plan:
        rows = rows.where(F.col("plan_name") == F.lit(plan))
    if since is not None:
        rows = rows.where(F.col("duedate") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("duedate") <= F.lit(until))
    if status:
        rows = rows.where(F.col("payment_status") == F.lit(status))
    if text:
        rows = rows.where(_contains(text, "member_name", "memberid"))
    return rows


def find_checkins(
    t: ClubTables, as_of: AsOf, text: str | None = None, day=None, inside: bool | None = None
) -> DataFrame:
    """Visits by day, by visitor's name, and by whether they have ended."""
    rows = views.all_checkins(t, as_of)
    if day is not None:
        rows = rows.where(F.col("date") == F.lit(day))
    if inside is not None:
        rows = rows.where(F.col("exittime").isNull() == F.lit(inside))
    if text:
        rows = rows.where(_contains(text, "name"))
    return rows


def find_classes(
    t: ClubTables, as_of: AsOf, instructor: str | None = None, room: str | None = None, day=None
) -> DataFrame:
    rows = views.all_classes(t, as_of)
    if day is not None:
        rows = rows.where(F.col("date") == F.lit(day))
    if room:
        rows = rows.where(F.col("room") == F.lit(room))
    if instructor:
        rows = rows.where(F.col("instructor_name") == F.lit(instructor))
    return rows


def find_machines(
    t: ClubTables, as_of: AsOf, text: str | None = None, kind: str | None = None,
    status: str | None = None,
) -> DataFrame:
    rows = views.machines(t, as_of)
    if text:
        rows = rows.where(_contains(text, "name", "machineid"))
    if kind:
        rows = rows.where(F.col("type") == F.lit(kind))
    if status:
        rows = rows.where(F.col("status") == F.lit(status))
    return rows
