"""The questions the club's pages ask, for one user or for a set of users.

``users`` is a user's number or a DataFrame whose first column holds numbers. Rows keep
the ``userid`` they belong to. Sorts end in the key, so ties repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palestra.asof import AsOf
from palestra.functions.display import (
    NOTHING_DUE,
    date_text,
    money_text,
    or_default,
    rounded_hours,
)
from palestra.operators.existence import maybe_present
from palestra.operators.joins import Hint, fits, only_users
from palestra.operators.ranking import first_per_group, first_rows
from palestra.plans import views
from palestra.plans.parts import (
    lowest_first,
    member_users,
    newest_first,
    open_classes,
)
from palestra.session import durable
from palestra.sources.tables import ClubTables

PAYMENTS_SHOWN = 10
VISITS_SHOWN = 15
CHECKINS_SHOWN = 100


def for_users(t: ClubTables, users) -> ClubTables:
    """The tables cut down to some users: their member and instructor rows, and what
    belongs to those members.

    A user has at most one row of each kind and a member at most two subscriptions, so for
    few users the keys are few and the large tables are filtered in place. For many, the
    large tables stay whole and their joins with the members select the rows.
    """
    if isinstance(users, DataFrame):
        users = users.distinct()
        hint = Hint(fits(users))
        users = hint(users)
    else:
        hint = Hint(True)
    member = hint(only_users(t["member"], users))
    people = t.with_tables(member=member, instructor=hint(only_users(t["instructor"], users)))
    if not hint.small:
        return people
    memberids = hint(member.select("memberid"))
    subscription = t["membersubscription"].join(memberids, "memberid", "left_semi")
    return people.with_tables(
        membersubscription=subscription,
        checkin=t["checkin"].join(memberids, "memberid", "left_semi"),
        classbooking=t["classbooking"].join(memberids, "memberid", "left_semi"),
        payment=t["payment"].join(
            hint(subscription.select("subscriptionid")), "subscriptionid", "left_semi"
        ),
    )


def _first_per_user(df: DataFrame, users, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each user; for one user in order."""
    if isinstance(users, DataFrame):
        return first_per_group(df, "userid", order, k)
    return first_rows(df, order, k)


def users_by_email(t: ClubTables, as_of: AsOf, emails) -> DataFrame:
    """Login rows of active users by exact email: one address, or a DataFrame of them."""
    found = only_users(views.user_authentication(t, as_of), emails, "email")
    order = lowest_first("userid")
    if isinstance(emails, DataFrame):
        return first_per_group(found, "email", order, 1)
    return first_rows(found, order, 1)


def registration_plans(t: ClubTables, as_of: AsOf) -> DataFrame:
    return views.plan_choices(t, as_of)


def emails_taken(
    t: ClubTables, as_of: AsOf, emails: DataFrame, known_by: tuple[DataFrame, int] | None = None
) -> DataFrame:
    """The given rows with ``taken``: whether a user has this ``email``. ``known_by`` is a
    stored filter of all emails with its bits; only emails that it may hold are joined."""
    known = views.email_exists(t, as_of).select("email", F.lit(True).alias("taken"))
    if known_by is not None:
        maybe = durable(maybe_present(emails, "email", *known_by))
        known = known.join(Hint(fits(maybe))(maybe), "email", "left_semi")
    return emails.join(known, "email", "left").withColumn(
        "taken", F.coalesce("taken", F.lit(False))
    )


def month_summary(t: ClubTables, as_of: AsOf, users) -> DataFrame:
    """This month's figures as the member's home page shows them."""
    stats = views.member_stats_month(for_users(t, users), as_of)
    due = F.when(F.col("next_payment").isNotNull(), F.col("payment_price"))
    return stats.select(
        "userid",
        F.col("checkin_count").alias("recent_checkins"),
        F.col("class_bookings").alias("month_classes_frequented"),
        rounded_hours(F.col("total_hours")).alias("total_hours"),
        or_default(date_text(F.col("next_payment")), NOTHING_DUE).alias("next_payment"),
        money_text(due).alias("payment_price"),
    )


def booked_classes(t: ClubTables, as_of: AsOf, users) -> DataFrame:
    """Classes from today on that the users have booked."""
    # the instructors of the classes are other people
    own = for_users(t, users).with_tables(instructor=t["instructor"])
    booked, _ = views.schedule_bookings(own, as_of)
    return booked.where("userid IS NOT NULL").select(
        "userid", "class_name", "date", "starttime", "endtime", "room", "instructor_name"
    )


def bookable_classes(t: ClubTables, as_of: AsOf, user: int) -> DataFrame:
    """Today's classes with free spots that the user has not booked yet. A user who is no
    member sees them all."""
    member = only_users(member_users(t), user).select("memberid")
    booked = t["classbooking"].join(F.broadcast(member), "memberid", "left_semi")
    # what one member has booked for one day is small, but the planner need not know
    return (
        open_classes(t, as_of, later_than=as_of.time_us)
        .join(booked.select("classscheduleid"), "classscheduleid", "left_anti")
        .select(
            F.lit(user).cast("bigint").alias("userid"), "classscheduleid", "class_name", "date",
            "starttime", "endtime", "room", "instructor_name", "available_spots",
        )
    )


def account_details(t: ClubTables, as_of: AsOf, users) -> DataFrame:
    """One profile row per user, with the nearest payment."""
    details = views.member_account_details(for_users(t, users), as_of)
    return _first_per_user(details, users, lowest_first("memberid", "next_payment_date"), 1)


def last_payments(t: ClubTables, as_of: AsOf, users, k: int = PAYMENTS_SHOWN) -> DataFrame:
    rows = views.payment_history_rows(for_users(t, users), as_of)
    order = newest_first("payment_date") + lowest_first("paymentid")
    return _first_per_user(rows, users, order, k)


def last_visits(t: ClubTables, as_of: AsOf, users, k: int = VISITS_SHOWN) -> DataFrame:
    rows = views.checkin_history_rows(for_users(t, users), as_of)
    order = newest_first("checkin_date", "entrancetime") + lowest_first("checkinid")
    return _first_per_user(rows, users, order, k)


def instructor_profile(t: ClubTables, as_of: AsOf, users) -> DataFrame:
    found = views.instructor_info(for_users(t, users), as_of)
    return _first_per_user(found, users, lowest_first("instructorid"), 1)


def taught_classes(t: ClubTables, as_of: AsOf, users) -> DataFrame:
    return views.instructor_classes(for_users(t, users), as_of).select(
        "userid", "classid", "name", "room", "capacity", "duration_minutes"
    )


def taught_schedules(t: ClubTables, as_of: AsOf, users) -> DataFrame:
    """Schedules of the instructors' classes by date and start."""
    return (
        views.class_schedules(for_users(t, users), as_of)
        .select("userid", "classscheduleid", "name", "date", "starttime", "endtime",
                "maxparticipants", "room")
        .orderBy(*lowest_first("date", "starttime", "classscheduleid"))
    )


def dashboard(t: ClubTables, as_of: AsOf) -> DataFrame:
    return views.dashboard_stats(t, as_of).select(
        "total_members", "total_instructors", "active_memberships",
        F.col("today_checkins").alias("today_checkins_count"),
    )


def member_list(t: ClubTables, as_of: AsOf) -> DataFrame:
    """All members, newest registration first."""
    return views.all_members(t, as_of).orderBy(
        *newest_first("registrationdate"), *lowest_first("memberid")
    )


def class_list(t: ClubTables, as_of: AsOf) -> DataFrame:
    return views.all_classes(t, as_of).orderBy(
        *lowest_first("date", "starttime", "classscheduleid")
    )


def latest_checkins(t: ClubTables, as_of: AsOf, k: int = CHECKINS_SHOWN) -> DataFrame:
    order = newest_first("date", "entrancetime") + lowest_first("checkinid")
    return first_rows(views.all_checkins(t, as_of), order, k)


def machine_list(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Machines by name, in byte order of the name."""
    return views.machines(t, as_of).orderBy(*lowest_first("name", "machineid"))


def payment_list(t: ClubTables, as_of: AsOf) -> DataFrame:
    return views.payments(t, as_of).orderBy(*newest_first("duedate"), *lowest_first("paymentid"))


def plan_list(t: ClubTables, as_of: AsOf) -> DataFrame:
    return views.plans(t, as_of).orderBy(*lowest_first("monthlyprice", "planid"))


def member_logins(t: ClubTables, as_of: AsOf) -> DataFrame:
    """Login columns of the users who are members."""
    return (
        t["users"].select("userid", "email", "password").join(member_users(t), "userid")
        .select("userid", "memberid", "email", "password")
    )


def all_bookings(t: ClubTables, as_of: AsOf) -> DataFrame:
    return t["classbooking"].select("*")
