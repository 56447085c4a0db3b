"""Stored tables, continuous intake, and the database source's options."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from conftest import NOW, day, dicts, frame, local, moment
from test_jobs import signup, SIGNUP

from palestra.plans import views
from palestra.operators.running import read_counts
from palestra.plans.registration import register_members
from palestra.session import application_folder, durable, workspace
from palestra.sources.jdbc import range_options, source_query
from palestra.sources.schema import TABLES
from palestra.sources.seeds import SEED_ROWS
from palestra.sources.stored import StoredTables
from palestra.streaming.intake import rejects, request_stream, start_intake, take_in


@pytest.fixture
def store(spark, tmp_path):
    store = StoredTables(spark, str(tmp_path / "store"), keys_per_range=10)
    store.create_all(NOW)
    return store


def visit(key, date, member=1):
    return dict(checkinid=key, memberid=member, date=day(date), entrancetime=1)


def files(store, name):
    """Every data file of a table with the time it was written."""
    return {str(f): f.stat().st_mtime_ns for f in Path(store.path(name)).rglob("*.parquet")}


def test_tables_are_created_anew_with_lookup_rows(spark, store):
    t = store.tables()
    assert {name: t[name].count() for name in TABLES} == {name: len(SEED_ROWS.get(name, [])) for name in TABLES}
    store.insert("checkin", frame(spark, "checkin", [visit(1, "2024-02-01")]))
    store.insert("plan", frame(spark, "plan", [dict(planid=77, name="x", monthlyprice=1)]))
    assert (store.read("checkin").count(), store.read("plan").count()) == (1, 4)
    store.create_all(NOW)
    assert (store.read("checkin").count(), store.read("plan").count()) == (0, 3)
    labels = [r["label"] for r in dicts(store.read("usertype").orderBy("usertypeid"))]
    assert labels == ["Gestor", "Instrutor", "Membro"]


@pytest.mark.parametrize("unit", ["day", "month"])
def test_a_batch_touches_its_folders_only(spark, tmp_path, unit):
    store = StoredTables(spark, str(tmp_path), unit=unit)
    dates = ["2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"]
    store.create("checkin", frame(spark, "checkin", [visit(10 * k + j, d) for k, d in enumerate(dates) for j in range(3)]))
    before = files(store, "checkin")

    # one row moves from January to April, one of April goes, one new comes to May
    store.merge("checkin", frame(spark, "checkin", [visit(1, "2024-04-01"), visit(99, "2024-05-01", 7)]),
                spark.createDataFrame([(31,), (12345,)], "gone BIGINT"))
    after = files(store, "checkin")
    untouched = lambda found: {f: t for f, t in found.items() if "2024-02" in f or "2024-03" in f}
    assert untouched(before) and untouched(before) == untouched(after)
    touched = {f for f in before if "2024-01" in f or "2024-04" in f}
    assert touched and not touched & set(after)
    rows = {r["checkinid"]: str(r["date"]) for r in dicts(store.read("checkin"))}
    assert rows == {0: dates[0], 2: dates[0], 10: dates[1], 11: dates[1], 12: dates[1], 20: dates[2], 21: dates[2],
                    22: dates[2], 30: dates[3], 32: dates[3], 1: dates[3], 99: "2024-05-01"}
    assert store.read("checkin").schema.names == TABLES["checkin"].names

    # the same batch again changes no row
    store.merge("checkin", frame(spark, "checkin", [visit(1, "2024-04-01"), visit(99, "2024-05-01", 7)]),
                spark.createDataFrame([(31,)], "gone BIGINT"))
    assert {r["checkinid"]: str(r["date"]) for r in dicts(store.read("checkin"))} == rows

    # a folder that loses its last row goes
    store.merge("checkin", gone=spark.createDataFrame([(99,)], "gone BIGINT"))
    assert not any("2024-05" in f for f in files(store, "checkin"))
    assert store.read("checkin").count() == len(rows) - 1


def test_updates_keep_other_key_ranges(spark, store):
    users = [dict(userid=k, email=f"{k}@x.pt", password="12345678", name="A", usertypeid=3, updated_at=moment("2024-01-01"))
             for k in range(25)]
    store.insert("users", frame(spark, "users", users))
    before = files(store, "users")
    changes = local(spark, [("userid", "bigint"), ("name", "string")], [(3, "B"), (4, None), (500, "C")])
    unknown = store.update("users", changes, NOW)
    assert [r["userid"] for r in dicts(unknown)] == [500]
    after = files(store, "users")
    assert {f for f in before if "key_range=0" not in f} == {f for f in after if "key_range=0" not in f}
    found = {r["userid"]: (r["name"], r["updated_at"]) for r in dicts(store.read("users"))}
    assert found[3] == ("B", NOW.ts) and found[4] == (None, NOW.ts) and found[5] == ("A", moment("2024-01-01")) and len(found) == 25


def test_a_failed_write_shows_nothing(spark, store):
    store.insert("checkin", frame(spark, "checkin", [visit(1, "2024-02-01")]))
    broken = frame(spark, "checkin", [visit(1, "2024-02-01"), visit(2, "2024-02-01")]).withColumn(
        "memberid", F.raise_error(F.lit("lost")).cast("bigint")
    )
    with pytest.raises(Exception, match="lost"):
        store.merge("checkin", broken)
    assert [r["memberid"] for r in dicts(store.read("checkin"))] == [1]


def write_lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_stream_of_signups_then_bookings(spark, store, tmp_path):
    names = [n for n, _ in SIGNUP]
    inbox = tmp_path / "signups"
    write_lines(inbox, "1.json", [dict(zip(names, signup(1, "a@x.pt", "200000001"))),
                                  dict(zip(names, signup(2, "a@x.pt", "200000002")))])

    def run(kind, folder):
        query = start_intake(
            store, kind, request_stream(spark, kind, str(folder)), str(tmp_path / f"state-{kind}"),
            clock=lambda: NOW, availableNow=True,
        )
        query.awaitTermination(120)
        assert query.exception() is None

    run("signup", inbox)
    write_lines(inbox, "2.json", [dict(zip(names, signup(3, "b@x.pt", "200000003")))])
    run("signup", inbox)
    t = store.tables()
    assert sorted((r["userid"], r["email"]) for r in dicts(t["users"])) == [
        (1, "a@x.pt"), (2, "b@x.pt")]
    assert [r["request_id"] for r in dicts(rejects(store, "signup"))] == [2]
    assert views.member_data(t, NOW).count() == 2

    schedule = dict(classscheduleid=5, classid=1, date=NOW.date, starttime=1, endtime=2)
    store.insert("classschedule", frame(spark, "classschedule", [schedule]))
    booking = dict(request_id="r1", userid=2, classscheduleid=5,
                   requested_at="2024-02-29T08:00:00")
    write_lines(tmp_path / "bookings", "1.json", [booking, {**booking, "request_id": "r2"}])
    run("booking", tmp_path / "bookings")
    assert [(r["memberid"], r["bookingdate"]) for r in dicts(store.tables()["classbooking"])] == [
        (2, moment("2024-02-29 08:00:00"))]
    assert [r["request_id"] for r in dicts(rejects(store, "booking"))] == ["r2"]
    assert [(r["classscheduleid"], r["booked"]) for r in dicts(read_counts(spark, store.root))] == [(5, 1)]

    write_lines(tmp_path / "logins", "1.json", [
        dict(userid=1, logged_in_at="2024-02-29T09:00:00"),
        dict(userid=9, logged_in_at="2024-02-29T09:00:00")])
    run("login", tmp_path / "logins")
    logins = {r["userid"]: r["last_login"] for r in dicts(store.tables()["users"])}
    assert logins == {1: moment("2024-02-29 09:00:00"), 2: None}
    assert rejects(store, "login").count() == 1


@pytest.mark.parametrize("lost", ["nothing", "_merged", "_complete"])
def test_repeated_micro_batch_changes_nothing(spark, store, lost):
    """Also if the batch failed after its outcome was written, or while it was written."""
    rows = local(spark, SIGNUP, [signup(1, "a@x.pt", "200000001"), signup(2, "a@x.pt", "200000002")])
    take_in(store, "signup", rows, "signup-0", NOW)
    if lost != "nothing":
        marks = Path(store.root) / "intake/signup/signup-0"
        (marks / "_merged").unlink()
        if lost == "_complete":  # nothing of it is in the tables yet
            (marks / "_complete").unlink()
            for name in ("users", "member", "membersubscription"):
                store.create(name)
    take_in(store, "signup", rows, "signup-0", NOW)
    assert [(r["userid"], r["email"]) for r in dicts(store.read("users"))] == [(1, "a@x.pt")]
    assert store.read("member").count() == store.read("membersubscription").count() == 1
    assert [r["request_id"] for r in dicts(rejects(store, "signup"))] == [2]


def test_intake_leaves_no_working_tables_and_no_passwords(spark, store):
    take_in(store, "signup", local(spark, SIGNUP, [signup(1, "a@x.pt", "200000001", password="verysecret")]), "b", NOW)
    folder = Path(application_folder(spark).removeprefix("file:"))
    assert not list(folder.glob("work-*"))
    with workspace(spark) as work:
        registration = register_members(store.tables(), NOW, local(spark, SIGNUP, [signup(2, "b@x.pt", "200000002", password="verysecret")]))
        assert registration.users.count() == 1
        kept = list(Path(work.removeprefix("file:")).rglob("*.parquet"))
        assert kept and not any(b"verysecret" in f.read_bytes() for f in kept)
    assert not Path(work.removeprefix("file:")).exists()


def test_checkpoints_use_the_named_folder(spark):
    durable(spark.range(3))
    assert spark.sparkContext.getCheckpointDir()


def test_database_reads_cut_by_key_and_turn_times_into_numbers():
    query = source_query("checkin")
    assert "CAST(EXTRACT(EPOCH FROM entrancetime) * 1000000 AS BIGINT) AS entrancetime" in query
    assert query.endswith("FROM checkin) AS checkin")
    options = range_options("checkin", 1, 1000, 16)
    assert options["partitionColumn"] == "checkinid"
    assert (options["lowerBound"], options["upperBound"], options["numPartitions"]) == (
        "1", "1001", "16")
    assert range_options("plan", 1, 3, 16)["numPartitions"] == "3"


def test_a_large_update_is_cut_by_its_rows(spark, tmp_path, monkeypatch):
    """Past a broadcast, one task's share of an update follows the rows, not the session's
    number of shuffle partitions (2 here)."""
    import palestra.operators.joins as joins
    import palestra.sources.stored as stored

    monkeypatch.setattr(stored, "fits", lambda df, max_rows=0: False)
    monkeypatch.setattr(stored, "ROWS_PER_TASK", 5, raising=False)
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 5)
    store = StoredTables(spark, str(tmp_path / "store"), keys_per_range=1000)
    store.create("users")
    users = [dict(userid=k, email=f"{k}@x.pt", password="12345678", name="A", usertypeid=3, updated_at=moment("2024-01-01"))
             for k in range(60)]
    store.insert("users", frame(spark, "users", users))
    changes = local(spark, [("userid", "bigint"), ("name", "string")], [(k, f"B{k}") for k in range(0, 60, 2)] + [(500, "C")])
    unknown = store.update("users", changes, NOW)
    assert [r["userid"] for r in dicts(unknown)] == [500]
    found = {r["userid"]: (r["name"], r["updated_at"]) for r in dicts(store.read("users"))}
    assert found == {k: (f"B{k}", NOW.ts) if k % 2 == 0 else ("A", moment("2024-01-01")) for k in range(60)}
    assert len(files(store, "users")) >= 12
