"""Intake and change jobs against one-at-a-time processing in plain Python."""

import contextlib
import io
import random
import re

import pytest
from conftest import NOW, club, day, dicts, local, moment

from palestra.operators.changes import change_keys, delete_rows, update_rows, with_defaults
from palestra.operators.numbering import numbered
from palestra.plans.bookings import book_classes
from palestra.plans.logins import apply_logins
from palestra.plans import registration
from palestra.plans.registration import EMAIL_TAKEN, NIF_TAKEN, PLAN_UNKNOWN, register_members
from palestra.sources import fixture

SIGNUP = [(c, "string") for c in (
    "name password email nif phone iban birthdate gender address city postalcode plan").split()]
SIGNUP = [("request_id", "bigint"), *SIGNUP]


def signup(request_id, email, nif, **more):
    values = {"request_id": request_id, "name": "Ana", "password": "longenough", "email": email,
              "nif": nif, "phone": "+351 911", "iban": "PT50" + "0" * 15,
              "birthdate": "1990-02-03", "gender": "Outro", "address": "Rua", "city": "Porto",
              "postalcode": "4000", "plan": "2", **more}
    return tuple(values[name] for name, _ in SIGNUP)


@pytest.fixture(scope="module")
def stored(spark):
    return club(
        spark,
        users=[dict(userid=7, email="old@x.pt", password="12345678", name="Old", usertypeid=3)],
        member=[dict(memberid=4, userid=7, nif="111111111", phone="1", iban="P" * 20,
                     birthdate=day("1990-01-01"), address="a", city="c", postalcode="p")],
        membersubscription=[dict(subscriptionid=9, planid=1, memberid=4, enddate=NOW.date)],
        classschedule=[dict(classscheduleid=k, classid=1, date=NOW.date, starttime=1, endtime=2)
                       for k in range(1, 6)],
        classbooking=[dict(bookingid=50, memberid=4, classscheduleid=1)],
    )


def test_signup_reasons(spark, stored):
    cases = {
        1: (signup(1, "a@x.pt", "200000001"), None),
        2: (signup(2, "old@x.pt", "200000002"), EMAIL_TAKEN),
        3: (signup(3, "b@x.pt", "111111111"), NIF_TAKEN),
        4: (signup(4, "c@x.pt", "200000004", plan="8"), PLAN_UNKNOWN),
        5: (signup(5, "d@x.pt", "200000005\n"), "length:nif"),
        6: (signup(6, "e@x.pt", "20000000"), "Q-05 nif"),
        7: (signup(7, "no address", "200000007"), "Q-03 email"),
        8: (signup(8, "f@x.pt", "200000008", birthdate="1990-02-31"), "required:birthdate"),
        9: (signup(9, "g@x.pt", "200000009", password="short"), "Q-04 password"),
        10: (signup(10, "h@x.pt", "200000010", gender=""), "Q-08 gender"),
        11: (signup(11, "i@x.pt", "200000011", plan=""), PLAN_UNKNOWN),
        12: (signup(12, "a@x.pt", "200000012"), EMAIL_TAKEN),
        13: (signup(13, "j@x.pt", "200000001"), NIF_TAKEN),
        14: (signup(14, "a@x.pt", "200000014", plan="8"), EMAIL_TAKEN),
        15: (signup(15, "A@x.pt", "200000015   ", name="n" * 120 + "  ", gender=None), None),
    }
    done = register_members(stored, NOW, local(spark, SIGNUP, [row for row, _ in cases.values()]))
    reasons = {r["request_id"]: r["reason"] for r in dicts(done.rejects)}
    assert reasons == {k: reason for k, (_, reason) in cases.items() if reason}
    users = sorted(dicts(done.users), key=lambda r: r["userid"])
    assert [(u["userid"], u["email"], u["usertypeid"], u["isactive"]) for u in users] == [
        (8, "a@x.pt", 3, True), (22, "A@x.pt", 3, True)]
    assert users[1]["name"] == "n" * 120 and users[0]["created_at"] == NOW.ts
    members = sorted(dicts(done.member), key=lambda r: r["memberid"])
    assert [(m["memberid"], m["userid"], m["nif"]) for m in members] == [
        (5, 8, "200000001"), (19, 22, "200000015")]
    assert members[0]["registrationdate"] == NOW.date
    subscriptions = sorted(dicts(done.membersubscription), key=lambda r: r["subscriptionid"])
    assert [(s["subscriptionid"], s["memberid"], s["planid"]) for s in subscriptions] == [
        (10, 5, 2), (24, 19, 2)]
    # one year after 29 February
    assert subscriptions[0]["startdate"] == NOW.date
    assert subscriptions[0]["enddate"] == day("2025-02-28")


@pytest.mark.parametrize("seed", [0, 20])
def test_signups_one_after_the_other(spark, stored, seed):
    rng = random.Random(seed)
    rows = [
        signup(i, f"u{rng.randrange(60)}@x.pt", f"3{rng.randrange(60):08}")
        for i in rng.sample(range(1, 1000), 200)
    ]
    # a chain in which each request shares something with the next
    rows += [signup(2000 + i, f"c{(i + 1) // 2}@x.pt", f"4{i // 2:08}") for i in range(12)]
    emails, nifs, accepted = set(), set(), []
    for arrival, row in enumerate(sorted(rows), start=1):
        if row[3] not in emails and row[4] not in nifs:
            emails.add(row[3])
            nifs.add(row[4])
            accepted.append((7 + arrival, row[3], row[4]))
    done = register_members(stored, NOW, local(spark, SIGNUP, rows))
    users = sorted(dicts(done.users), key=lambda r: r["userid"])
    assert [(u["userid"], u["email"]) for u in users] == [(k, email) for k, email, _ in accepted]
    members = sorted(dicts(done.member), key=lambda r: r["memberid"])
    assert [m["nif"] for m in members] == [nif for _, _, nif in accepted]
    assert done.rejects.count() == len(rows) - len(accepted)


def test_a_long_chain_settles_in_few_rounds(spark, stored, monkeypatch):
    rounds = []
    plain = registration._outcomes
    monkeypatch.setattr(registration, "_outcomes", lambda df: rounds.append(1) or plain(df))
    rows = [signup(i, f"c{(i + 1) // 2}@x.pt", f"4{i // 2:08}") for i in range(1000)]
    done = register_members(stored, NOW, local(spark, SIGNUP, rows))
    assert done.users.count() == 500 and len(rounds) <= 15


def test_no_signup_accepted(spark, stored):
    done = register_members(stored, NOW, local(spark, SIGNUP, [signup(1, "old@x.pt", "2" * 9)]))
    assert done.users.count() == done.membersubscription.count() == 0
    assert done.rejects.count() == 1


BOOKING = [("request_id", "string"), ("userid", "bigint"), ("classscheduleid", "bigint"),
           ("requested_at", "timestamp")]


def test_bookings(spark, stored):
    at = moment("2024-02-20 10:00:00")
    rows = [
        ("a", 7, 2, at), ("b", 7, 2, at), ("c", 7, 3, moment("2024-02-20 09:00:00")),
        ("d", 7, 1, at), ("e", 8, 2, at), ("f", 7, 99, at), ("g", None, 2, at),
    ]
    requests = local(spark, BOOKING, rows)
    done = book_classes(stored, NOW, requests)
    assert sorted((r["bookingid"], r["memberid"], r["classscheduleid"])
                  for r in dicts(done.classbooking)) == [(51, 4, 3), (52, 4, 2)]
    assert {r["request_id"]: r["reason"] for r in dicts(done.rejects)} == {
        "b": "This class is already booked for this member",
        "d": "This class is already booked for this member",
        "e": "Member not found for user ID 8",
        "f": "Class schedule not found",
        "g": "Member not found for user ID ",
    }
    after = stored.with_tables(
        classbooking=stored["classbooking"].unionByName(done.classbooking))
    again = book_classes(after, NOW, requests)
    assert again.classbooking.count() == 0 and again.rejects.count() == len(rows)


def test_bookings_onto_an_empty_table(spark):
    path = "/root/testdata/sf0.001"
    t = fixture.mapped_tables(spark, path)
    empty = t.with_tables(classbooking=t["classbooking"].limit(0))
    done = book_classes(empty, fixture.FIXTURE_AS_OF, fixture.requests(spark, path, "booking"))
    assert done.classbooking.count() == 4497
    counts = {r["kind"]: r["n"] for r in done.rejects.selectExpr("left(reason, 6) AS kind")
              .groupBy("kind").agg({"*": "count"}).toDF("kind", "n").collect()}
    assert counts == {"Member": 1464, "This c": 39}


def _odd_bookings(spark):
    """Random requests against users and schedules that are missing, NULL or in store twice;
    with the outcome of taking them one after the other."""
    rng = random.Random(4)
    members = [(1, 11), (2, 12), (3, 12), (4, 13), (4, 13), (5, None), (None, 14), (None, 15), (6, 15)]
    schedules = [1, 2, 3, 4, 4, 5, None]
    booked = [(1, 1), (2, 2), (6, 3), (1, None), (None, 3)]
    t = club(
        spark,
        member=[dict(memberid=m, userid=u, nif="1", phone="1", iban="P", birthdate=day("1990-01-01"), address="a",
                     city="c", postalcode="p") for m, u in members],
        classschedule=[dict(classscheduleid=k, classid=1, date=NOW.date, starttime=1, endtime=2) for k in schedules],
        classbooking=[dict(bookingid=40 + i, memberid=m, classscheduleid=c) for i, (m, c) in enumerate(booked)],
    )
    rows = [
        (f"r{i:03}", rng.choice([11, 12, 13, 14, 15, 99, None]), rng.choice([1, 2, 3, 4, 5, 77, None]),
         rng.choice([None, *(moment(f"2024-02-{d} 10:00:00") for d in (20, 21, 22))]))
        for i in rng.sample(range(1000), 120)
    ]
    rows += rows[:15]
    order = lambda r: (r[3] is not None, str(r[3]), r[0], r[1] is not None, r[1], r[2] is not None, r[2])
    taken, accepted, rejects = set(booked), [], []
    for arrival, row in enumerate(sorted(rows, key=lambda r: tuple(0 if x is None else x for x in order(r))), start=1):
        _, user, schedule, at = row
        found = [m for m, u in members if u == user and user is not None] or [None]
        copies = max(1, schedules.count(schedule)) if schedule is not None else 1
        known = schedule is not None and schedule in schedules
        new = {(m, schedule) for m in found if m is not None and known} - taken
        taken |= new
        accepted += [(44 + arrival, *pair, at) for pair in new]
        if not new:
            rejects += [
                (*row, f"Member not found for user ID {'' if user is None else user}" if m is None
                 else "This class is already booked for this member" if known else "Class schedule not found")
                for m in found for _ in range(copies)
            ]
    return t, local(spark, BOOKING, rows), accepted, rejects


@pytest.mark.parametrize("large", ["no", "shuffled", "shuffled and spread"])
def test_odd_bookings_one_after_the_other(spark, monkeypatch, large):
    from palestra.operators import joins
    from palestra.plans import bookings

    t, requests, accepted, rejects = _odd_bookings(spark)
    if large != "no":
        monkeypatch.setattr(bookings, "fits", lambda df: False)
    if "spread" in large:
        monkeypatch.setattr(joins, "ROWS_PER_TASK", 30)
    done = book_classes(t, NOW, requests)
    got = done.classbooking.select("bookingid", "memberid", "classscheduleid", "bookingdate").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, accepted))
    assert sorted(map(str, map(tuple, done.rejects.collect()))) == sorted(map(str, rejects))
    assert accepted and len(rejects) > len(accepted)


def test_many_bookings_shuffle_their_fields_once(spark, monkeypatch):
    from palestra.operators import joins
    from palestra.plans import bookings

    t, requests, _, _ = _odd_bookings(spark)
    monkeypatch.setattr(bookings, "fits", lambda df: "held" in df.columns)  # few schedules are odd
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 30)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            book_classes(t, NOW, requests).rejects.explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: ([^\n]*)", out.getvalue())
    wide = [how for columns, how in dealt if "request_id#" in columns]
    assert len(wide) == 1
    # 135 requests of 30 a task
    assert re.match(r"hashpartitioning\(arrival#\d+L, 5\)", wide[0])


def test_logins(spark, stored):
    events = [(7, moment("2024-02-01")), (7, moment("2024-02-03")), (8, moment("2024-02-02"))]
    columns = [("userid", "bigint"), ("logged_in_at", "timestamp")]
    done = apply_logins(stored, NOW, local(spark, columns, events))
    assert [(r["last_login"], r["updated_at"]) for r in dicts(done.users)] == [
        (moment("2024-02-03"), NOW.ts)]
    assert dicts(done.rejects) == [dict(userid=8, reason="User with ID 8 not found")]
    late = local(spark, columns, events[:1])
    again = apply_logins(stored.with_tables(users=done.users), NOW, late)
    assert dicts(again.users)[0]["last_login"] == moment("2024-02-03")


def test_update_stamps_only_touched_rows(spark, stored):
    rows = stored["classschedule"].withColumn("updated_at", NOW.month_start_timestamp())
    changes = local(spark, [("classscheduleid", "bigint"), ("maxparticipants", "int")],
                    [(1, 5), (2, None), (77, 1)])
    after, unknown = update_rows(rows, "classscheduleid", changes, NOW)
    assert sorted((r["classscheduleid"], r["maxparticipants"], r["updated_at"] == NOW.ts)
                  for r in dicts(after))[:3] == [(1, 5, True), (2, None, True), (3, None, False)]
    assert [r["classscheduleid"] for r in dicts(unknown)] == [77]


def test_defaults_fill_absent_columns_only(spark):
    given = local(spark, [("checkinid", "bigint"), ("memberid", "bigint"), ("date", "date")],
                  [(1, 2, None)])
    row = dicts(with_defaults(given, "checkin", NOW))[0]
    assert row["date"] is None and row["entrancetime"] == NOW.time_us
    assert row["exittime"] is None and row["created_at"] == NOW.ts
    log = local(spark, [("logid", "bigint")], [(1,)])
    assert dicts(with_defaults(log, "machinemaintenancelog", NOW))[0]["maintenancetype"] == "ROUTINE"


def test_delete_clears_or_refuses(spark, stored):
    after, refused = delete_rows(stored, "users", local(spark, [("k", "bigint")], [(7,)]), NOW)
    assert refused.count() == 0 and after["users"].count() == 0
    assert [(m["userid"], m["updated_at"]) for m in dicts(after["member"])] == [(None, NOW.ts)]
    after, refused = delete_rows(stored, "member", local(spark, [("k", "bigint")], [(4,), (5,)]), NOW)
    assert sorted(r["held_by"] for r in dicts(refused)) == ["classbooking", "membersubscription"]
    assert after["member"].count() == 1
    after, refused = delete_rows(
        stored, "classschedule", local(spark, [("k", "bigint")], [(1,), (2,)]), NOW)
    assert [r["classscheduleid"] for r in dicts(refused)] == [1]
    assert sorted(r["classscheduleid"] for r in dicts(after["classschedule"])) == [1, 3, 4, 5]


def test_key_changes_cascade(spark, stored):
    renames = local(spark, [("old_key", "bigint"), ("new_key", "bigint")],
                    [(4, 40), (5, 50)])
    after, refused = change_keys(stored, "member", renames, NOW)
    assert [r["memberid"] for r in dicts(after["member"])] == [40]
    assert [r["memberid"] for r in dicts(after["classbooking"])] == [40]
    assert [(r["memberid"], r["updated_at"]) for r in dicts(after["membersubscription"])] == [
        (40, NOW.ts)]
    assert [(r["old_key"], r["new_key"]) for r in dicts(refused)] == [(5, 50)]
    clash = local(spark, [("old_key", "bigint"), ("new_key", "bigint")], [(1, 2), (3, 9), (4, 9)])
    _, refused = change_keys(stored, "classschedule", clash, NOW)
    assert refused.count() == 3


def test_numbers_follow_the_order(spark):
    rows = spark.range(5000).selectExpr("id", "pmod(hash(id), 3) AS part")
    got = dicts(numbered(rows, ["part", "id"]))
    expected = sorted((r["part"], r["id"]) for r in got)
    by_position = sorted(got, key=lambda r: r["position"])
    assert [(r["part"], r["id"]) for r in by_position] == expected
    assert [r["position"] for r in by_position] == list(range(1, 5001))
