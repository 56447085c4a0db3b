"""The screens' figures in DuckDB SQL."""

from oracle.mapping import sql
from oracle.views import BODIES as VIEWS

_PLAN_MEMBERS = """
    SELECT p.name AS plan_name, p.monthlyprice, s.startdate
    FROM g_membersubscription s, g_member g, g_plan p
    WHERE s.isactive AND g.isactive AND s.memberid = g.memberid AND s.planid = p.planid
"""
_CELLS = """
    SELECT s.date, s.starttime // $hour AS hour, k.room,
           CAST(sum((SELECT count(*) FROM g_classbooking b
                     WHERE b.classscheduleid = s.classscheduleid)) AS BIGINT) AS enrolled,
           CAST(sum(s.maxparticipants) AS BIGINT) AS places
    FROM g_classschedule s JOIN g_class k USING (classid)
    WHERE s.isactive AND s.date >= $today
    GROUP BY ALL
"""

BODIES = {
    "x01_monthly_revenue": """
        SELECT a.month, a.revenue, b.revenue AS revenue_before,
               CAST(a.revenue - b.revenue AS DOUBLE) / CAST(b.revenue AS DOUBLE) * 100.0::DOUBLE
                   AS change_percent
        FROM m a LEFT JOIN m b ON b.month = CAST(a.month - INTERVAL 1 MONTH AS DATE)
    """,
    "x02_payment_states": f"""
        SELECT state, CAST(sum(payment_amount) AS DECIMAL(20,2)) AS amount, count(*) AS payments,
               count(DISTINCT memberid) AS members
        FROM (SELECT payment_status AS state, payment_amount, memberid
              FROM ({VIEWS["v20_member_payment_history"]}) WHERE payment_status <> 'Pago'
              UNION ALL
              SELECT 'Hoje', payment_amount, memberid
              FROM ({VIEWS["v20_member_payment_history"]}) WHERE paymentdate = $today)
        GROUP BY state
    """,
    "x03_visits_today": """
        SELECT count(*) FILTER (date = $today) AS checkins,
               count(*) FILTER (date = $today) - count(*) FILTER (date = $today - 1) AS change,
               count(*) FILTER (date = $today AND exittime IS NULL) AS inside
        FROM g_checkin
    """,
    "x03_month_visitors": """
        SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(DISTINCT memberid) AS visitors
        FROM g_checkin GROUP BY 1
    """,
    "x04_busiest_half_hours": """
        SELECT date, printf('%02d:%02d', slot // 2, slot % 2 * 30) AS half_hour, n AS checkins
        FROM (SELECT date, entrancetime // 1800000000 AS slot, count(*) AS n
              FROM g_checkin GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY date ORDER BY n DESC, slot) = 1
    """,
    "x05_members_per_plan": f"""
        SELECT plan_name, count(*) AS members,
               CAST(count(*) AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM ({_PLAN_MEMBERS}))
                   * 100.0::DOUBLE AS share
        FROM ({_PLAN_MEMBERS}) GROUP BY plan_name
    """,
    "x06_plan_performance": f"""
        SELECT plan_name AS plan, min(monthlyprice) AS price, count(*) AS members,
               count(*) FILTER (startdate BETWEEN $month AND $today) AS new_members,
               CAST(sum(monthlyprice) AS DECIMAL(20,2)) AS monthly_income
        FROM ({_PLAN_MEMBERS}) GROUP BY plan_name
        UNION ALL
        SELECT 'Total', NULL, count(*),
               count(*) FILTER (startdate BETWEEN $month AND $today),
               CAST(sum(monthlyprice) AS DECIMAL(20,2))
        FROM ({_PLAN_MEMBERS})
    """,
    "x07_machines_per_status": """
        SELECT z.status, count(*) AS machines,
               CAST(count(*) AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM g_machine)
                   * 100.0::DOUBLE AS share
        FROM g_machine q JOIN g_machinestatus z USING (machinestatusid) GROUP BY z.status
    """,
    "x08_class_grid_cells": _CELLS,
    "x08_class_grid": f"""
        SELECT hour, {", ".join(
            f"max(CAST(enrolled AS VARCHAR) || '/' || CAST(places AS VARCHAR)) FILTER (room = '{r}') AS \"{r}\""
            for r in ("Brand#1", "Brand#5", "Brand#12", "Brand#20"))}
        FROM ({_CELLS}) WHERE date = $today GROUP BY hour ORDER BY hour
    """,
    "x09_instructor_month": """
        SELECT k.instructorid, count(DISTINCT s.classscheduleid) AS classes,
               CAST((SELECT sum(endtime - starttime) FROM month_schedule z JOIN g_class c
                     USING (classid) WHERE c.instructorid = k.instructorid) AS BIGINT)
                   / CAST($hour AS DOUBLE) AS hours,
               count(b.bookingid) AS bookings, count(DISTINCT b.memberid) AS people,
               CAST(count(b.bookingid) AS DOUBLE)
                   / CAST((SELECT sum(maxparticipants) FROM month_schedule z JOIN g_class c
                           USING (classid) WHERE c.instructorid = k.instructorid) AS DOUBLE)
                   * 100.0::DOUBLE AS occupancy
        FROM month_schedule s JOIN g_class k USING (classid)
        LEFT JOIN g_classbooking b USING (classscheduleid)
        GROUP BY k.instructorid
    """,
    "x10_find_members": f"""
        SELECT * FROM ({VIEWS["v14_all_members"]})
        WHERE (name ILIKE '%9%' OR email ILIKE '%9%') AND isactive AND plan_name = 'Premium'
    """,
    "x10_find_members_indexed": f"""
        SELECT * FROM ({VIEWS["v14_all_members"]})
        WHERE (name ILIKE '%0004%' OR email ILIKE '%0004%') AND isactive
    """,
    "x10_find_members_indexed_short": f"""
        SELECT * FROM ({VIEWS["v14_all_members"]})
        WHERE (name ILIKE '%#0%' OR email ILIKE '%#0%') AND plan_name = 'Premium'
    """,
    "x10_find_payments": f"""
        SELECT v.*, h.payment_status, h.memberid
        FROM ({VIEWS["v18_payments"]}) v
        JOIN ({VIEWS["v20_member_payment_history"]}) h USING (paymentid)
        WHERE (v.member_name ILIKE '%7%' OR CAST(h.memberid AS VARCHAR) LIKE '%7%')
          AND h.payment_status = 'Em Atraso' AND v.plan_name = 'Basico'
          AND v.duedate BETWEEN DATE '2022-01-20' AND $today
    """,
    "x10_find_checkins": f"""
        SELECT * FROM ({VIEWS["v16_all_checkins"]})
        WHERE date = $today AND exittime IS NULL AND name LIKE '%1%'
    """,
    "x10_find_classes": f"""
        SELECT * FROM ({VIEWS["v15_all_classes"]})
        WHERE instructor_name = 'Supplier#000000003' AND room = 'Brand#5'
    """,
    "x10_find_machines": f"""
        SELECT * FROM ({VIEWS["v17_machines"]})
        WHERE (name ILIKE '%ring%' OR CAST(machineid AS VARCHAR) LIKE '%ring%')
          AND type = 'LARGE' AND status = 'Em funcionamento'
    """,
}
_REVENUE = """(
    SELECT CAST(date_trunc('month', paymentdate) AS DATE) AS month, CAST(sum(amount) AS DECIMAL(20,2)) AS revenue
    FROM g_payment WHERE ispayed AND paymentdate IS NOT NULL GROUP BY 1)"""
BODIES["x01_monthly_revenue"] = (
    BODIES["x01_monthly_revenue"]
    .replace("FROM m a", f"FROM {_REVENUE} a").replace("JOIN m b", f"JOIN {_REVENUE} b")
)
BODIES["x09_instructor_month"] = BODIES["x09_instructor_month"].replace(
    "month_schedule",
    "(SELECT * FROM g_classschedule WHERE isactive AND date BETWEEN $month AND DATE '2024-01-31')",
)

ORACLE = {name: sql(body) for name, body in BODIES.items()}
