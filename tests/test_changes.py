"""Redelivered tables, batches over several tables, deliveries, running counts and indexes."""

import contextlib
import io
import random
import re

import pytest
from conftest import NOW, club, day, dicts, frame, local, moment
from pyspark.sql import functions as F

from palestra.operators.cascades import change_batch, children_first, delete_batch
from palestra.operators.differences import differences, redelivered
from palestra.operators.existence import build_filter, filter_bits, grown, maybe_present
from palestra.operators.running import booking_deltas, merge_counts, read_counts
from palestra.operators.text_index import candidates, sorted_postings, write_postings
from palestra.plans.club_rules import rules_of
from palestra.plans.deliveries import take_delivery
from palestra.sources.schema import REFERENCES, TABLES
from palestra.sources.stored import StoredTables


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


OLD = moment("2024-01-01")


def machines(spark, rows):
    base = dict(machinestatusid=1, type="t", installationdate=day("2020-01-01"), maintenancedate=day("2021-01-01"),
                created_at=OLD, updated_at=OLD)
    return frame(spark, "machine", [{**base, **r} for r in rows])


def test_redelivered_rows(spark):
    stored = machines(spark, [dict(machineid=1, name="a"), dict(machineid=2, name="b", model="x"),
                              dict(machineid=3, name="c", manufacturer="m"), dict(machineid=4, name="d")])
    again = machines(spark, [dict(machineid=1, name="a"), dict(machineid=2, name="b", manufacturer="x"),
                             dict(machineid=3, name="c"), dict(machineid=9, name="e")]).drop("created_at", "updated_at")
    after, kinds = redelivered(stored, again, "machine", NOW)
    # a value that moves to the next column is a change, as is one that becomes NULL
    assert {r["machineid"]: r["kind"] for r in dicts(kinds)} == {2: "changed", 3: "changed", 4: "removed", 9: "inserted"}
    rows = {r["machineid"]: r for r in dicts(after)}
    assert {k: (r["created_at"], r["updated_at"]) for k, r in rows.items()} == {
        1: (OLD, OLD), 2: (OLD, NOW.ts), 3: (OLD, NOW.ts), 9: (NOW.ts, NOW.ts)}
    assert (rows[2]["manufacturer"], rows[2]["model"], rows[3]["manufacturer"]) == ("x", None, None)
    kept, _ = redelivered(stored, again, "machine", NOW, remove=False)
    assert sorted(r["machineid"] for r in dicts(kept)) == [1, 2, 3, 4, 9]
    assert differences(stored, stored, "machineid").isEmpty()
    empty = stored.limit(0)
    assert {r["kind"] for r in dicts(differences(empty, stored, "machineid"))} == {"inserted"}
    assert redelivered(stored, empty, "machine", NOW)[0].isEmpty()


def test_differences_shuffle_keys_and_hashes_only(spark):
    stored = machines(spark, [dict(machineid=1, name="a")])
    text = plan(differences(stored, stored.withColumn("name", F.lit("z")), "machineid"))
    # after the plan is final its stages are listed once more
    assert text.split("== Initial Plan ==")[0].count("hashpartitioning") == 1


def test_tables_come_before_what_they_point_at():
    order = children_first(TABLES)
    assert all(order.index(r.child) < order.index(r.parent) for r in REFERENCES)


def people(spark):
    return club(
        spark,
        users=[dict(userid=k, email=f"{k}@x", password="p", name="n", usertypeid=3) for k in (1, 2, 3)],
        member=[dict(memberid=k, userid=k, nif=str(k), phone="1", iban="i", birthdate=day("1990-01-01"), address="a", city="c",
                     postalcode="p", updated_at=OLD) for k in (1, 2, 3)],
        membersubscription=[dict(subscriptionid=k, planid=k, memberid=k, enddate=NOW.date) for k in (1, 2)],
        payment=[dict(paymentid=5, subscriptionid=2, amount=1, duedate=NOW.date)],
        classschedule=[dict(classscheduleid=k, classid=1, date=NOW.date, starttime=1, endtime=2) for k in (1, 2)],
        classbooking=[dict(bookingid=1, memberid=1, classscheduleid=1), dict(bookingid=2, memberid=2, classscheduleid=2)],
        checkin=[dict(checkinid=1, memberid=1, date=NOW.date, entrancetime=1)],
    )


def keys(spark, *values):
    return local(spark, [("k", "bigint")], [(v,) for v in values])


def test_a_member_goes_with_its_bookings(spark):
    t = people(spark)
    alone, refused = delete_batch(t, {"member": keys(spark, 1)}, NOW)
    assert alone["member"].count() == 3
    assert {(r["row_id"], r["held_by"]) for r in dicts(refused)} == {
        (1, "membersubscription"), (1, "classbooking"), (1, "checkin")}

    wanted = {"users": keys(spark, 1, 3), "member": keys(spark, 1, 2), "classbooking": keys(spark, 1, 2), "checkin": keys(spark, 1),
              "membersubscription": keys(spark, 1, 2), "classschedule": keys(spark, 1, 99), "plan": keys(spark, 1, 2, 3)}
    after, refused = delete_batch(t, wanted, NOW)
    # the payment holds its subscription, which holds member 2 and plan 2; user 3 goes, its member is cleared
    assert {(r["table_name"], r["row_id"], r["held_by"]) for r in dicts(refused)} == {
        ("membersubscription", 2, "payment"), ("member", 2, "membersubscription"), ("plan", 2, "membersubscription")}
    left = {n: sorted(r[0] for r in after[n].select(TABLES[n].key).collect()) for n in wanted}
    assert left == {"users": [2], "member": [2, 3], "classbooking": [], "checkin": [], "membersubscription": [2],
                    "classschedule": [2], "plan": [2]}
    members = {r["memberid"]: (r["userid"], r["updated_at"]) for r in dicts(after["member"])}
    assert members == {2: (2, OLD), 3: (None, NOW.ts)}


def test_a_large_delete_spreads_its_joins_by_rows(spark, monkeypatch):
    import palestra.operators.changes as changes
    import palestra.operators.joins as joins

    t = people(spark)
    wanted = {"users": keys(spark, 1, 3), "member": keys(spark, 1, 2), "classbooking": keys(spark, 1, 2), "checkin": keys(spark, 1),
              "membersubscription": keys(spark, 1, 2), "classschedule": keys(spark, 1, 99), "plan": keys(spark, 1, 2, 3)}
    small, small_refused = delete_batch(t, wanted, NOW)
    # key sets too large to broadcast, and tasks that take one row each
    monkeypatch.setattr(changes, "fits", lambda df: False)
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 1)
    large, large_refused = delete_batch(t, wanted, NOW)
    assert sorted(dicts(large_refused), key=str) == sorted(dicts(small_refused), key=str)
    for n in wanted:
        assert sorted(dicts(large[n]), key=str) == sorted(dicts(small[n]), key=str)
    rows = t["users"].count()
    assert rows > 2 and "hashpartitioning(userid#" in plan(large["users"])
    assert re.search(rf"hashpartitioning\(userid#\d+L?, {rows}\)", plan(large["users"]))


def test_keys_change_in_several_tables(spark):
    renames = lambda *pairs: local(spark, [("old_key", "bigint"), ("new_key", "bigint")], list(pairs))
    t = people(spark)
    after, refused = change_batch(
        t, {"member": renames((1, 11), (2, 3), (9, 19)), "classschedule": renames((1, 21)), "plan": renames((2, 22))}, NOW)
    assert sorted((r["table_name"], r["old_key"], r["new_key"]) for r in dicts(refused)) == [("member", 2, 3), ("member", 9, 19)]
    assert sorted((r["bookingid"], r["memberid"], r["classscheduleid"]) for r in dicts(after["classbooking"])) == [(1, 11, 21), (2, 2, 2)]
    assert sorted((r["subscriptionid"], r["planid"], r["memberid"]) for r in dicts(after["membersubscription"])) == [(1, 1, 11), (2, 22, 2)]
    assert sorted(r["memberid"] for r in dicts(after["checkin"])) == [11]


def test_a_delivery_is_judged_in_one_scan(spark, tmp_path):
    rows = [dict(machineid=1, name="a"), dict(machineid=2, name=" "), dict(machineid=3, name="c", maintenancedate=day("2019-01-01")),
            dict(machineid=4, name=None, maintenancedate=day("2019-01-01"))]
    machines(spark, rows).write.parquet(str(tmp_path / "given"))
    delivered = spark.read.parquet(str(tmp_path / "given"))
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("delivery", "one scan")
    done = take_delivery(delivered, "machine", str(tmp_path / "out"))
    jobs = seen.getJobIdsForGroup("delivery")
    spark.sparkContext.setJobGroup("", "")
    # one job of one stage reads the delivery, writes it and counts
    assert len(jobs) == 1 and len(seen.getJobInfo(jobs[0]).stageIds) == 1
    assert (done.total, done.valid.count(), done.rejects.count()) == (4, 1, 3)
    assert {r["rule"]: r["broken"] for r in dicts(done.counts)} == {"required:name": 1, "Q-09 name": 1, "Q-09 maintenance": 2}
    assert {r["machineid"]: r["rules"] for r in dicts(done.rejects)} == {
        2: ["Q-09 name"], 3: ["Q-09 maintenance"], 4: ["required:name", "Q-09 maintenance"]}
    nothing = take_delivery(delivered.limit(0), "machine", str(tmp_path / "none"), rules_of("machine"))
    assert nothing.total == 0 and nothing.counts.isEmpty() and nothing.valid.isEmpty()


def test_counts_follow_batches(spark, tmp_path):
    store = StoredTables(spark, str(tmp_path))
    rng = random.Random(1)
    made = [dict(bookingid=k, memberid=k % 40, classscheduleid=rng.choice([5, 1_000_005, 2_000_005, *range(10, 30)])) for k in range(300)]
    held = {}
    for k in range(3):
        batch, gone = made[100 * k : 100 * k + 100], made[max(0, 100 * k - 20) : 100 * k]
        deltas = booking_deltas(frame(spark, "classbooking", batch), frame(spark, "classbooking", gone) if gone else None)
        for _ in range(2):  # the latest batch may come again
            merge_counts(store, f"b{k}", deltas)
        for b in batch:
            held[b["classscheduleid"]] = held.get(b["classscheduleid"], 0) + 1
        for b in gone:
            held[b["classscheduleid"]] -= 1
        assert {r["classscheduleid"]: r["booked"] for r in dicts(read_counts(spark, store.root))} == held
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "bookingcount").rglob("*.parquet")}
    merge_counts(store, "b3", booking_deltas(frame(spark, "classbooking", [dict(bookingid=999, memberid=1, classscheduleid=5)])))
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "bookingcount").rglob("*.parquet")}
    others = {f: t for f, t in before.items() if "key_range=0" not in str(f)}
    assert others and others.items() <= after.items()


def test_the_filter_knows_all_keys_and_few_others(spark):
    stored = spark.range(20_000).selectExpr("concat('u', id, '@x.pt') AS email")
    bits = filter_bits(40_000)
    found = grown(build_filter(stored.where("length(email) % 2 = 0"), "email", bits),
                  build_filter(stored.where("length(email) % 2 = 1"), "email", bits)).cache()
    assert maybe_present(stored, "email", found, bits).count() == 20_000
    absent = spark.range(50_000).selectExpr("concat('v', id, '@x.pt') AS email")
    assert maybe_present(absent, "email", found, bits).count() < 0.02 * 50_000
    odd = local(spark, [("email", "string")], [(None,), ("",), ("u1@x.pt",), ("u1@x.pt",)])
    assert [r["email"] for r in dicts(maybe_present(odd, "email", found, bits))] == ["u1@x.pt"]
    assert maybe_present(stored, "email", found.limit(0), bits).isEmpty()


@pytest.mark.parametrize("text", ["an", "a", "ANA", "ana@x.pt", "ão", "%", "ana maria", "zzzz", "aaa"])
def test_postings_find_what_the_scan_finds(spark, tmp_path_factory, text):
    names = ["Ana", "ANA Maria", "João", "anana", None, "", "a", "Bananas", "100%", "aaaa", "aa", "ana  maria"]
    emails = ["ana@x.pt", None, "x", "JOAO@x.pt", "an@a", "", "b", "%", "ana@y.pt", "q", "w", "e"]
    rows = local(spark, [("userid", "bigint"), ("name", "string"), ("email", "string")], list(zip(range(12), names, emails)))
    path = str(tmp_path_factory.mktemp("postings"))
    write_postings(rows.where("userid < 6"), "userid", ["name", "email"], path)
    write_postings(rows.where("userid >= 6"), "userid", ["name", "email"], path, mode="append")
    found = candidates(spark, path, text, ["name", "email"])
    holds = lambda t: t is not None and text.lower() in t.lower()
    scan = {k for k, a, b in zip(range(12), names, emails) if holds(a) or holds(b)}
    got = {r["row_id"] for r in dicts(found)}
    assert scan <= got and (len(text) > 3 or scan == got)
    text = plan(found)
    assert re.search(r"PartitionFilters: \[[^\n]*folder#", text) and re.search(r"PushedFilters: \[[^\n]*\(gram,", text)


def test_postings_shuffle_the_rows_not_their_parts(spark):
    rows = local(spark, [("userid", "bigint"), ("name", "string"), ("email", "string")],
                 [(1, "Ana", "ana@x.pt"), (2, None, "b@y.pt"), (2, "Ana", None)])
    stored = sorted_postings(rows, "userid", ["name", "email"])
    text = plan(stored)
    assert "rangepartitioning" not in text.lower() and "Union" not in text
    assert text.index("Generate") < text.index("Exchange")  # the parts are made after the shuffle
    got = sorted((r["gram"], r["column"], r["row_id"]) for r in stored.collect())
    assert ("ana", "name", 1) in got and ("ana", "name", 2) in got and ("b@y", "email", 2) in got
    assert not [g for g in got if g[1] == "name" and g[2] == 2 and g[0] == "b"]
