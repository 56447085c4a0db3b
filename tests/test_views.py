"""Semantics that the mapped tables do not show, on hand-made rows."""

import pytest
from conftest import HOUR, MINUTE, NOW, club, day, dicts, local, moment

from palestra.plans import app_queries as app
from palestra.plans import views


def user(userid, kind=3, **more):
    return dict(userid=userid, email=f"u{userid}@x.pt", password="12345678", name=f"User {userid}",
                usertypeid=kind, **more)


def member(memberid, userid, **more):
    return dict(memberid=memberid, userid=userid, nif=f"{memberid:09}", phone="1", iban="P" * 20,
                registrationdate=day("2024-01-05"), birthdate=day("1990-01-01"), address="a",
                city="c", postalcode="p", **more)


def schedule(key, **more):
    return {"classscheduleid": key, "classid": 1, "date": NOW.date, "starttime": 10 * HOUR,
            "endtime": 11 * HOUR, "maxparticipants": 2, **more}


@pytest.fixture(scope="module")
def t(spark):
    return club(
        spark,
        users=[user(1), user(2), user(3, isactive=False), user(10, 2), user(20, 1)],
        member=[member(1, 1), member(2, 2), member(3, None), member(4, 3, isactive=False)],
        instructor=[
            dict(instructorid=5, userid=10, nif="000000005"),
            dict(instructorid=6, userid=None, nif="000000006"),
        ],
        **{"class": [
            dict(classid=1, instructorid=5, name="Yoga", room="A", capacity=10),
            dict(classid=2, instructorid=5, name="Box", room="B", capacity=10, isactive=False),
            dict(classid=3, instructorid=6, name="Run", room="B", capacity=10),
        ]},
        classschedule=[
            schedule(1),
            schedule(2, maxparticipants=None),
            schedule(3, starttime=9 * HOUR),
            schedule(4, classid=2),
            schedule(5, classid=3),
            schedule(6, maxparticipants=1),
            schedule(7, isactive=False),
            schedule(8, date=day("2024-02-28")),
            schedule(9, starttime=int(9.5 * HOUR)),
        ],
        classbooking=[
            dict(bookingid=1, memberid=1, classscheduleid=1, bookingdate=moment("2024-02-01")),
            dict(bookingid=2, memberid=2, classscheduleid=6, bookingdate=moment("2024-01-31 23:59:59")),
            dict(bookingid=3, memberid=1, classscheduleid=8, bookingdate=moment("2024-02-29 09:30:00")),
            dict(bookingid=4, memberid=1, classscheduleid=3, bookingdate=moment("2024-02-29 09:30:01")),
        ],
        membersubscription=[
            dict(subscriptionid=1, planid=2, memberid=1, startdate=day("2024-01-01"),
                 enddate=day("2025-01-01")),
            dict(subscriptionid=2, planid=1, memberid=2, startdate=day("2023-01-01"),
                 enddate=day("2024-01-01"), isactive=False),
        ],
        payment=[
            dict(paymentid=1, subscriptionid=1, amount=30, duedate=day("2024-02-01")),
            dict(paymentid=2, subscriptionid=1, amount=30, duedate=day("2024-02-29")),
            dict(paymentid=3, subscriptionid=1, amount=30, duedate=day("2024-01-31")),
            dict(paymentid=4, subscriptionid=1, amount=30, duedate=day("2024-03-01"),
                 ispayed=True, paymentdate=day("2024-03-01")),
            dict(paymentid=5, subscriptionid=2, amount=20, duedate=day("2024-03-05")),
        ],
        checkin=[
            dict(checkinid=1, memberid=1, date=NOW.date, entrancetime=HOUR, exittime=HOUR + 5 * MINUTE),
            dict(checkinid=2, memberid=1, date=day("2024-02-01"), entrancetime=0, exittime=25 * MINUTE),
            dict(checkinid=3, memberid=1, date=NOW.date, entrancetime=2 * HOUR),
            dict(checkinid=4, memberid=1, date=day("2024-01-31"), entrancetime=0, exittime=9 * HOUR),
            dict(checkinid=5, memberid=3, date=NOW.date, entrancetime=8 * HOUR, exittime=20 * HOUR),
            dict(checkinid=6, memberid=1, date=day("2024-03-01"), entrancetime=0, exittime=HOUR),
        ],
    )


def test_month_stats_multiply_hours_and_keep_counts(t):
    rows = {r["memberid"]: r for r in dicts(views.member_stats_month(t, NOW))}
    assert set(rows) == {1, 2, 3}
    one = rows[1]
    # 3 visits this month, 2 bookings up to now, 2 unpaid payments since the month began
    assert (one["checkin_count"], one["class_bookings"]) == (3, 2)
    assert one["total_hours"] == pytest.approx(0.5 * 2 * 2)
    assert one["next_payment"] == day("2024-02-01")
    assert rows[2]["total_hours"] is None and rows[2]["payment_price"] is None
    assert rows[3]["total_hours"] == 12 and rows[3]["userid"] is None
    true_hours = {r["memberid"]: r["total_hours"]
                  for r in dicts(views.member_stats_month_corrected(t, NOW))}
    assert true_hours[1] == pytest.approx(0.5)


def test_schedule_rows_survive_without_booking(t):
    rows = dicts(views.member_schedule_classes(t, NOW))
    assert len(rows) == 8 - 1
    assert sorted(r["userid"] for r in rows if r["userid"]) == [1, 1, 2]
    assert any(r["instructor_name"] is None and r["class_name"] == "Run" for r in rows)


def test_available_classes(t):
    rows = dicts(views.member_available_classes(t, NOW))
    # 2 has no limit, 3 and 9 have begun, 4 is inactive, 5 has no instructor user, 6 is full
    assert [(r["classscheduleid"], r["current_bookings"], r["available_spots"]) for r in rows] == [
        (1, 1, 1)
    ]


def test_account_details_list_each_upcoming_payment(t):
    rows = [(r["memberid"], r["next_payment_date"], r["plan_name"])
            for r in dicts(views.member_account_details(t, NOW))]
    assert sorted(rows, key=str) == [
        (1, day("2024-02-29"), "Premium"), (2, None, None), (3, None, None), (4, None, None),
    ]


def test_members_without_user_drop_out_of_inner_joins(t):
    assert 5 not in {r["checkinid"] for r in dicts(views.all_checkins(t, NOW))}
    assert 5 in {r["checkinid"] for r in dicts(views.member_checkin_history(t, NOW))}


def test_dashboard(t):
    assert dicts(views.dashboard_stats(t, NOW)) == [
        dict(total_members=3, total_instructors=2, active_memberships=1, today_checkins=3)
    ]


def test_visit_texts(t):
    rows = {r["checkinid"]: r for r in dicts(views.member_checkin_history(t, NOW))}
    assert rows[1]["duration_formatted"] == "0h 05min"
    assert rows[5]["duration_formatted"] == "12h 00min"
    assert rows[3]["duration_formatted"] == "Em curso" and rows[3]["duration_hours"] is None


def test_payment_states(t):
    rows = {r["paymentid"]: r["payment_status"]
            for r in dicts(views.member_payment_history(t, NOW))}
    assert rows == {1: "Em Atraso", 2: "Pendente", 3: "Em Atraso", 4: "Pago", 5: "Pendente"}


def test_one_user_equals_the_set_of_one(spark, t):
    for query in (app.month_summary, app.booked_classes, app.account_details,
                  app.last_payments, app.last_visits, app.instructor_profile, app.taught_classes,
                  app.taught_schedules):
        for userid in (1, 10):
            single = dicts(query(t, NOW, userid))
            as_set = dicts(query(t, NOW, local(spark, [("who", "bigint")], [(userid,)])))
            assert sorted(map(str, single)) == sorted(map(str, as_set)), (query.__name__, userid)


def test_month_summary_texts(t):
    one = dicts(app.month_summary(t, NOW, 1))[0]
    assert one["total_hours"] == 2 and one["next_payment"] == "01/02/2024"
    assert one["payment_price"] == "30.00€"
    two = dicts(app.month_summary(t, NOW, 2))[0]
    assert (two["total_hours"], two["next_payment"], two["payment_price"]) == (
        0, "Pagamento em dia", "0.00€")


def test_unknown_user_sees_every_open_class(t):
    assert [r["classscheduleid"] for r in dicts(app.bookable_classes(t, NOW, 77))] == [1]
    assert dicts(app.bookable_classes(t, NOW, 1)) == []


def test_last_rows_come_newest_first(t):
    assert [r["checkinid"] for r in dicts(app.last_visits(t, NOW, 1, k=3))] == [6, 3, 1]
    assert [r["paymentid"] for r in dicts(app.last_payments(t, NOW, 1, k=2))] == [4, 2]
    assert [r["checkinid"] for r in dicts(app.latest_checkins(t, NOW, k=3))] == [6, 3, 1]
    assert [r["checkinid"] for r in dicts(app.latest_checkins(t, NOW, k=50))] == [6, 3, 1, 2, 4]


def test_login_by_email_is_exact(t):
    assert [r["userid"] for r in dicts(app.users_by_email(t, NOW, "u1@x.pt"))] == [1]
    assert dicts(app.users_by_email(t, NOW, "U1@x.pt")) == []
    assert dicts(app.users_by_email(t, NOW, "u3@x.pt")) == []


def test_views_by_name(spark, t):
    t.register_views(["users"])
    views.register_views(t, NOW)
    assert spark.sql("SELECT count(*) AS n FROM vw_email_exists").first()["n"] == 5
    assert spark.sql("SELECT label FROM vw_user_authentication a JOIN (SELECT 'Gestor' AS label) l"
                     " ON l.label = a.user_type_label").count() == 1
    assert len([v for v in spark.catalog.listTables() if v.name.startswith("vw_")]) == 20
