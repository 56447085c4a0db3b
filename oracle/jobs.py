"""The intake and change jobs in DuckDB SQL."""

from oracle.mapping import sql

# Sign-ups one after the other: each accepted one takes its email and its NIF.
_WALKED = r"""
    SELECT * FROM (
        WITH RECURSIVE asked AS (
            SELECT *, row_number() OVER (ORDER BY request_id) AS n,
                   CASE WHEN email IN (SELECT email FROM g_users) THEN 'Este email já está registado.'
                        WHEN NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$')
                        THEN 'Q-03 email'
                        WHEN NOT regexp_matches(nif, '^[0-9]{9}$') THEN 'Q-05 nif'
                        WHEN nif IN (SELECT nif FROM g_member) THEN 'NIF already registered'
                        WHEN plan NOT IN (SELECT planid FROM g_plan) THEN 'Plan not found' END AS own
            FROM r_signup
        ), walk AS (
            SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS emails,
                   CAST([] AS VARCHAR[]) AS nifs, CAST(NULL AS VARCHAR) AS reason
            UNION ALL
            SELECT n, CASE WHEN reason IS NULL THEN list_append(emails, email) ELSE emails END,
                   CASE WHEN reason IS NULL THEN list_append(nifs, nif) ELSE nifs END, reason
            FROM (
                SELECT a.n, a.email, a.nif, w.emails, w.nifs,
                       CASE WHEN list_contains(w.emails, a.email) THEN 'Este email já está registado.'
                            WHEN a.own IS NOT NULL THEN a.own
                            WHEN list_contains(w.nifs, a.nif) THEN 'NIF already registered' END AS reason
                FROM walk AS w JOIN asked AS a ON a.n = w.n + 1
            ) AS step
        )
        SELECT asked.*, walk.reason FROM asked JOIN walk USING (n)
    ) AS outcome
"""
_ACCEPTED = _WALKED + " WHERE reason IS NULL"
_NEXT_USER = "(SELECT max(userid) FROM g_users)"
_NEXT_MEMBER = "(SELECT max(memberid) FROM g_member)"
_NEXT_SUBSCRIPTION = "(SELECT max(subscriptionid) FROM g_membersubscription)"
_STAMPS = "$now AS created_at, $now AS updated_at"

_JUDGED = """
    SELECT q.*, g.memberid,
           g.memberid IS NOT NULL
           AND EXISTS (SELECT 1 FROM g_classschedule s
                       WHERE s.classscheduleid = q.classscheduleid) AS possible,
           EXISTS (SELECT 1 FROM g_classbooking b
                   WHERE b.memberid = g.memberid AND b.classscheduleid = q.classscheduleid
                     AND b.bookingdate <= $now) AS stored
    FROM (SELECT *, row_number() OVER (
              ORDER BY requested_at, request_id, userid, classscheduleid) AS n
          FROM r_booking) q
    LEFT JOIN g_member g USING (userid)
"""
_RANKED = f"""
    SELECT *, row_number() OVER (PARTITION BY memberid, classscheduleid, possible
                                 ORDER BY n) AS turn
    FROM ({_JUDGED})
"""

BODIES = {
    "m01_new_users": f"""
        SELECT {_NEXT_USER} + n AS userid, email, password, name, 3 AS usertypeid,
               true AS isactive, CAST(NULL AS TIMESTAMP) AS last_login,
               $now AS password_changed_at, {_STAMPS}
        FROM ({_ACCEPTED})
    """,
    "m01_new_members": f"""
        SELECT {_NEXT_MEMBER} + n AS memberid, {_NEXT_USER} + n AS userid, nif, phone, iban,
               $today AS registrationdate, birthdate, gender, address, city, postalcode,
               true AS isactive, {_STAMPS}
        FROM ({_ACCEPTED})
    """,
    "m01_new_subscriptions": f"""
        SELECT {_NEXT_SUBSCRIPTION} + n AS subscriptionid, plan AS planid,
               {_NEXT_MEMBER} + n AS memberid, $today AS startdate, DATE '2025-01-20' AS enddate,
               true AS isactive, {_STAMPS}
        FROM ({_ACCEPTED})
    """,
    "m01_signup_rejects": f"SELECT request_id, reason FROM ({_WALKED}) WHERE reason IS NOT NULL",
    "m02_new_bookings": f"""
        SELECT n + (SELECT max(bookingid) FROM g_classbooking WHERE bookingdate <= $now)
                   AS bookingid,
               memberid, classscheduleid, requested_at AS bookingdate, {_STAMPS}
        FROM ({_RANKED}) WHERE possible AND NOT stored AND turn = 1
    """,
    "m02_booking_rejects": f"""
        SELECT request_id, userid, classscheduleid, requested_at,
               CASE WHEN memberid IS NULL THEN 'Member not found for user ID ' || userid
                    WHEN NOT possible THEN 'Class schedule not found'
                    ELSE 'This class is already booked for this member' END AS reason
        FROM ({_RANKED}) WHERE NOT possible OR stored OR turn > 1
    """,
    "m03_users_after_logins": """
        SELECT userid, email, password, name, usertypeid, isactive,
               (SELECT max(seen) FROM (SELECT logged_in_at AS seen FROM r_login q
                                       WHERE q.userid = w.userid
                                       UNION ALL SELECT w.last_login) AS logins) AS last_login,
               password_changed_at, created_at,
               CASE WHEN userid IN (SELECT userid FROM r_login) THEN $now
                    ELSE updated_at END AS updated_at
        FROM g_users w
    """,
    "m03_login_rejects": """
        SELECT DISTINCT userid, 'User with ID ' || userid || ' not found' AS reason
        FROM r_login WHERE userid NOT IN (SELECT userid FROM g_users)
    """,
    "m04_overdue_settled": """
        SELECT paymentid, subscriptionid, amount, ispayed OR late AS ispayed, duedate,
               if(late, $today, paymentdate) AS paymentdate, paymentmethod, reference, created_at,
               if(late, $now, updated_at) AS updated_at
        FROM (SELECT *, NOT ispayed AND duedate < $today AS late FROM g_payment)
    """,
    "m05_checkin_defaults": """
        SELECT checkinid + 1 + (SELECT max(checkinid) FROM g_checkin) AS checkinid, memberid,
               $today AS date, $clock AS entrancetime, CAST(NULL AS BIGINT) AS exittime,
               $now AS created_at, $now AS updated_at
        FROM g_checkin
    """,
    "m06_visits_numbered": """
        SELECT checkinid, date, entrancetime,
               row_number() OVER (ORDER BY date, entrancetime, checkinid) AS position
        FROM g_checkin
    """,
    "m07_inactive_users_deleted": """
        SELECT 'member' AS table_name, g.memberid AS row_id, w.userid,
               if(w.userid IS NULL, $now, g.updated_at) AS updated_at
        FROM g_member g LEFT JOIN g_users w ON w.userid = g.userid AND w.isactive
        UNION ALL
        SELECT 'instructor', t.instructorid, w.userid, if(w.userid IS NULL, $now, t.updated_at)
        FROM g_instructor t LEFT JOIN g_users w ON w.userid = t.userid AND w.isactive
    """,
    "m07_inactive_classes_refused": """
        SELECT classid, 'classschedule' AS held_by FROM g_class k
        WHERE NOT isactive
          AND EXISTS (SELECT 1 FROM g_classschedule s WHERE s.classid = k.classid)
    """,
    "m07_inactive_classes_deleted": """
        SELECT * FROM g_class k
        WHERE isactive OR EXISTS (SELECT 1 FROM g_classschedule s WHERE s.classid = k.classid)
    """,
    "m07_instructors_renumbered": """
        SELECT 'class' AS table_name, k.classid AS row_id,
               if(t.isactive, t.instructorid + 5000000, t.instructorid) AS instructorid,
               if(t.isactive, $now, k.updated_at) AS updated_at
        FROM g_class k JOIN g_instructor t USING (instructorid)
        UNION ALL
        SELECT 'instructor', userid, if(isactive, instructorid + 5000000, instructorid),
               if(isactive, $now, updated_at)
        FROM g_instructor
    """,
}

# Visits with odd corrections: some a day later, some gone, some new.
_CORRECTED = """
    SELECT checkinid, memberid, if(checkinid % 50 = 7, date + 1, date) AS date, entrancetime, exittime,
           created_at, if(checkinid % 50 = 7, $now, updated_at) AS updated_at
    FROM g_checkin WHERE checkinid % 50 <> 8
"""
_NEW_VISITS = """
    SELECT checkinid + 1 + (SELECT max(checkinid) FROM g_checkin), memberid, $today, $clock,
           CAST(NULL AS BIGINT), $now, $now
    FROM g_checkin
"""
# The member table as it comes again: some rows new, some changed, some missing.
_AGAIN = """
    SELECT memberid, userid, nif, phone, iban, registrationdate, birthdate, gender, address, city,
           postalcode, isactive
    FROM d_member WHERE memberid % 23 <> 5
    UNION ALL
    SELECT memberid + 50000000, NULL, lpad(CAST(memberid + 50000000 AS VARCHAR), 9, '0'), phone,
           iban, registrationdate, birthdate, gender, address, city, postalcode, isactive
    FROM g_member WHERE memberid % 10 = 0
"""
_MEMBER_COLUMNS = """memberid, userid, nif, phone, iban, registrationdate, birthdate, gender,
    address, city, postalcode, isactive"""
_KIND = f"""
    SELECT coalesce(n.memberid, o.memberid) AS memberid,
           CASE WHEN o.memberid IS NULL THEN 'inserted' WHEN n.memberid IS NULL THEN 'removed'
                WHEN row(n.userid, n.nif, n.phone, n.iban, n.registrationdate, n.birthdate, n.gender,
                         n.address, n.city, n.postalcode, n.isactive)
                     IS DISTINCT FROM
                     row(o.userid, o.nif, o.phone, o.iban, o.registrationdate, o.birthdate, o.gender,
                         o.address, o.city, o.postalcode, o.isactive) THEN 'changed' END AS kind
    FROM ({_AGAIN}) n FULL JOIN g_member o ON o.memberid = n.memberid
"""

# A batch that deletes inactive members with their bookings and visits, their subscriptions
# that nobody paid for, some schedules without the bookings of others, and a plan.
_GONE_MEMBERS = "SELECT memberid FROM g_member WHERE NOT isactive"
_KEPT_SUBSCRIPTIONS = f"""
    SELECT * FROM g_membersubscription s
    WHERE NOT (memberid IN ({_GONE_MEMBERS})
               AND NOT EXISTS (SELECT 1 FROM g_payment y WHERE y.subscriptionid = s.subscriptionid))
"""
_KEPT_BOOKINGS = f"SELECT * FROM g_classbooking WHERE memberid NOT IN ({_GONE_MEMBERS})"
_KEPT_VISITS = f"SELECT * FROM g_checkin WHERE memberid NOT IN ({_GONE_MEMBERS})"
_KEPT_SCHEDULES = f"""
    SELECT * FROM g_classschedule s
    WHERE isactive OR classscheduleid IN (SELECT classscheduleid FROM ({_KEPT_BOOKINGS}))
"""
_KEPT_PLANS = f"""
    SELECT * FROM g_plan WHERE isactive AND planid <> 2
        OR planid IN (SELECT planid FROM ({_KEPT_SUBSCRIPTIONS}))
"""
_KEPT_MEMBERS = f"""
    SELECT * FROM g_member WHERE isactive OR memberid IN (SELECT memberid FROM ({_KEPT_SUBSCRIPTIONS}))
"""
_LEFT = [("checkin", "checkinid", _KEPT_VISITS), ("classbooking", "bookingid", _KEPT_BOOKINGS),
         ("membersubscription", "subscriptionid", _KEPT_SUBSCRIPTIONS),
         ("classschedule", "classscheduleid", _KEPT_SCHEDULES), ("plan", "planid", _KEPT_PLANS),
         ("member", "memberid", _KEPT_MEMBERS)]

BODIES |= {
    "s06_visits_inserted": f"SELECT * FROM g_checkin UNION ALL ({_NEW_VISITS})",
    "s07_payments_settled": BODIES["m04_overdue_settled"],
    "s07_visits_corrected": f"{_CORRECTED} UNION ALL ({_NEW_VISITS})",
    "s08_machines_after_recreation": """
        SELECT q.machineid, q.name, q.type, q.manufacturer, q.model, z.status,
               q.installationdate, q.maintenancedate
        FROM g_machine q JOIN g_machinestatus z USING (machinestatusid)
    """,
    "m04_member_differences": f"SELECT * FROM ({_KIND}) WHERE kind IS NOT NULL",
    "m04_members_redelivered": f"""
        SELECT {_MEMBER_COLUMNS}, created_at, updated_at FROM g_member
        WHERE memberid IN (SELECT memberid FROM ({_KIND}) WHERE kind IS NULL)
        UNION ALL
        SELECT n.*, coalesce((SELECT o.created_at FROM g_member o WHERE o.memberid = n.memberid), $now), $now
        FROM ({_AGAIN}) n WHERE n.memberid IN (SELECT memberid FROM ({_KIND}) WHERE kind IN ('inserted', 'changed'))
    """,
    "m07_batch_left": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, CAST({key} AS BIGINT) AS row_id FROM ({body})" for name, key, body in _LEFT
    ),
    "m07_batch_refused": f"""
        SELECT 'membersubscription' AS table_name, CAST(subscriptionid AS BIGINT) AS row_id, 'payment' AS held_by
        FROM ({_KEPT_SUBSCRIPTIONS}) WHERE memberid IN ({_GONE_MEMBERS})
        UNION ALL
        SELECT 'classschedule', classscheduleid, 'classbooking' FROM ({_KEPT_SCHEDULES}) WHERE NOT isactive
        UNION ALL
        SELECT 'plan', planid, 'membersubscription' FROM ({_KEPT_PLANS}) WHERE NOT isactive OR planid = 2
        UNION ALL
        SELECT 'member', memberid, 'membersubscription' FROM ({_KEPT_MEMBERS}) WHERE NOT isactive
    """,
    "m07_keys_changed": """
        SELECT 'classbooking' AS table_name, b.bookingid AS row_id,
               if(g.isactive, b.memberid + 50000000, b.memberid) AS memberid,
               if(s.isactive, b.classscheduleid + 70000000, b.classscheduleid) AS other_key,
               if(g.isactive OR s.isactive, $now, b.updated_at) AS updated_at
        FROM g_classbooking b JOIN g_member g USING (memberid) JOIN g_classschedule s USING (classscheduleid)
        UNION ALL
        SELECT 'membersubscription', u.subscriptionid, if(g.isactive, u.memberid + 50000000, u.memberid),
               CAST(if(u.planid = 2, 500, u.planid) AS BIGINT),
               if(g.isactive OR u.planid = 2, $now, u.updated_at)
        FROM g_membersubscription u JOIN g_member g USING (memberid)
    """,
    "a05_running_counts": """
        SELECT classscheduleid, count(*) FILTER (memberid % 10 <> 0) AS booked
        FROM g_classbooking GROUP BY classscheduleid
    """,
}

ORACLE = {name: sql(body) for name, body in BODIES.items()}
