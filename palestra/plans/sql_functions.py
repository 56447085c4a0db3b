"""Queries with a clock and a user, as table functions for users of SQL.

    SELECT * FROM last_payments(DATE '2024-01-20', 42)
    SELECT * FROM available_classes(TIMESTAMP_NTZ '2024-01-20 09:00:00')

A view cannot take the time or the user; these functions do, and are part of the query that
calls them, so filters and column pruning reach the tables. Call them with constants: behind
LATERAL Spark 4.1 does not resolve them rightly. For a set of users use ``plans/app_queries.py``.
"""

from __future__ import annotations

import re

from palestra.functions.clock import MICROS_PER_HOUR
from palestra.functions.display import NOTHING_DUE, OVERDUE, PAID, PENDING
from palestra.plans.app_queries import PAYMENTS_SHOWN
from palestra.sources.tables import ClubTables

PREFIX = "club_"

_TIME_OF_DAY = (
    "(CAST(hour(now) * 3600 + minute(now) * 60 AS BIGINT) * 1000000"
    " + CAST(extract(SECOND FROM now) * 1000000 AS BIGINT))"
)
# the first of the month
_MONTH = "date_trunc('MONTH', now)"
# Parameters are known in the main query and in tables derived in FROM, but not in CTEs.
_TODAY = f"""
    SELECT * FROM {PREFIX}classschedule
    WHERE isactive AND date = CAST(now AS DATE) AND starttime > {_TIME_OF_DAY} AND maxparticipants IS NOT NULL
"""


def _per_member(table: str, figures: str, condition: str) -> str:
    """Figures of the user's own rows of a table, per member."""
    return f"""
        SELECT x.memberid, {figures} FROM {PREFIX}{table} x JOIN {PREFIX}member m ON m.memberid = x.memberid
        WHERE m.userid = of_user AND {condition} GROUP BY x.memberid
    """


_VISITS = _per_member(
    "checkin", "count(*) AS n, sum(x.exittime - x.entrancetime) AS stay",
    f"x.date BETWEEN CAST({_MONTH} AS DATE) AND CAST(now AS DATE)",
)
_BOOKED = _per_member(
    "classbooking", "count(*) AS n", f"x.bookingdate BETWEEN CAST({_MONTH} AS TIMESTAMP_NTZ) AND now"
)
_DUE = f"""
    SELECT s.subscriptionid, count(*) AS n, min(y.duedate) AS next
    FROM {PREFIX}payment y JOIN {PREFIX}membersubscription s ON s.subscriptionid = y.subscriptionid
    JOIN {PREFIX}member m ON m.memberid = s.memberid
    WHERE m.userid = of_user AND s.isactive AND NOT y.ispayed AND y.duedate >= CAST({_MONTH} AS DATE)
    GROUP BY s.subscriptionid
"""

FUNCTIONS = {
    "available_classes": (
        "now TIMESTAMP_NTZ",
        "classscheduleid BIGINT, class_name STRING, room STRING, capacity INT, duration_minutes INT,"
        " instructor_name STRING, date DATE, starttime BIGINT, endtime BIGINT, maxparticipants INT,"
        " current_bookings BIGINT, available_spots BIGINT",
        f"""
        SELECT s.classscheduleid, k.name, k.room, k.capacity, k.duration_minutes, w.name, s.date, s.starttime,
               s.endtime, s.maxparticipants, coalesce(b.booked, 0), s.maxparticipants - coalesce(b.booked, 0)
        FROM ({_TODAY}) s
        LEFT JOIN (
            SELECT x.classscheduleid, count(*) AS booked
            FROM {PREFIX}classbooking x JOIN ({_TODAY}) q ON q.classscheduleid = x.classscheduleid
            GROUP BY x.classscheduleid
        ) b ON b.classscheduleid = s.classscheduleid
        JOIN {PREFIX}class k ON k.classid = s.classid AND k.isactive
        JOIN {PREFIX}instructor t ON t.instructorid = k.instructorid JOIN {PREFIX}users w ON w.userid = t.userid
        WHERE s.maxparticipants > coalesce(b.booked, 0)
        """,
    ),
    "last_payments": (
        "today DATE, of_user BIGINT",
        "paymentid BIGINT, payment_date DATE, payment_amount DECIMAL(10,2), paymentmethod STRING,"
        " payment_status STRING, paymentdate DATE, memberid BIGINT, userid BIGINT",
        f"""
        SELECT y.paymentid, y.duedate, y.amount, y.paymentmethod,
               CASE WHEN y.ispayed THEN '{PAID}' WHEN y.duedate < today THEN '{OVERDUE}' ELSE '{PENDING}' END,
               y.paymentdate, m.memberid, m.userid
        FROM {PREFIX}payment y JOIN {PREFIX}membersubscription s ON s.subscriptionid = y.subscriptionid
        JOIN {PREFIX}member m ON m.memberid = s.memberid
        WHERE m.userid = of_user
        ORDER BY y.duedate DESC NULLS FIRST, y.paymentid LIMIT {PAYMENTS_SHOWN}
        """,
    ),
    # visits, bookings and payments are counted apart; the definition multiplies the hours
    "month_summary": (
        "now TIMESTAMP_NTZ, of_user BIGINT",
        "userid BIGINT, recent_checkins BIGINT, month_classes_frequented BIGINT, total_hours BIGINT,"
        " next_payment STRING, payment_price STRING",
        f"""
        SELECT g.userid, coalesce(v.n, 0), coalesce(b.n, 0),
               CAST(bround(coalesce(v.stay * coalesce(b.n, 1) * coalesce(d.n, 1) / {MICROS_PER_HOUR}D, 0D)) AS BIGINT),
               coalesce(date_format(d.next, 'dd/MM/yyyy'), '{NOTHING_DUE}'),
               CASE WHEN d.next IS NULL OR p.monthlyprice IS NULL THEN '0.00€' ELSE CAST(p.monthlyprice AS STRING) || '€' END
        FROM (SELECT * FROM {PREFIX}member WHERE isactive AND userid = of_user) g
        LEFT JOIN ({_VISITS}) v ON v.memberid = g.memberid
        LEFT JOIN ({_BOOKED}) b ON b.memberid = g.memberid
        LEFT JOIN (SELECT * FROM {PREFIX}membersubscription WHERE isactive) s ON s.memberid = g.memberid
        LEFT JOIN {PREFIX}plan p ON p.planid = s.planid
        LEFT JOIN ({_DUE}) d ON d.subscriptionid = s.subscriptionid
        """,
    ),
}


def register_functions(t: ClubTables) -> None:
    """Make the functions callable in this session, and the tables they read readable as
    ``club_<name>``, replacing older ones."""
    for name in t:
        if any(re.search(rf"\b{PREFIX}{name}\b", body) for _, _, body in FUNCTIONS.values()):
            t[name].createOrReplaceTempView(f"{PREFIX}{name}")
    for name, (parameters, columns, body) in FUNCTIONS.items():
        t.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
