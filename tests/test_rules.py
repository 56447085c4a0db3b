import re

import pytest
from conftest import NOW, club, day, dicts, local

from palestra.operators.checks import check
from palestra.plans import club_rules as rules
from palestra.sources.schema import TABLES
from palestra.sources.seeds import SEED_ROWS, seed_table


def member(memberid, **more):
    return {"memberid": memberid, "userid": memberid, "nif": f"{memberid:09}", "phone": "1",
            "iban": "P" * 20, "birthdate": day("1990-01-01"), "address": "a", "city": "c",
            "postalcode": "p", **more}


@pytest.fixture(scope="module")
def t(spark):
    return club(
        spark,
        users=[dict(userid=1, email="A.b+c@X-y.PT", password="12345678", name="n", usertypeid=3),
               dict(userid=2, email="a@b.pt\n", password="1234567", name="  ", usertypeid=8)],
        instructor=[dict(instructorid=1, userid=None, nif="123456789", phone=None),
                    dict(instructorid=2, userid=None, nif="123456789\n", phone="")],
        member=[member(1), member(2, phone=None, nif="000000001"), member(3, userid=1),
                member(4, userid=None, gender="x"), member(5, userid=None, city="c" * 101)],
        payment=[dict(paymentid=1, subscriptionid=None, amount=1, duedate=day("2024-01-02"),
                      paymentdate=day("2024-01-01"), reference=None),
                 dict(paymentid=2, subscriptionid=3, amount=0, duedate=day("2024-01-02"),
                      reference=None)],
        membersubscription=[
            dict(subscriptionid=1, planid=1, memberid=1, enddate=NOW.date, isactive=True),
            dict(subscriptionid=2, planid=1, memberid=1, enddate=NOW.date, isactive=True),
            dict(subscriptionid=4, planid=1, memberid=1, enddate=NOW.date, isactive=False),
        ],
        checkin=[dict(checkinid=1, memberid=1, entrancetime=5, exittime=5),
                 dict(checkinid=2, memberid=1, entrancetime=5, exittime=None)],
    )


def lines(df):
    return sorted((r["table_name"], r["rule"], r["row_id"]) for r in dicts(df))


def test_checks_pass_on_null_and_catch_final_newlines(t):
    assert lines(rules.broken_rows(t, rules.CHECKS)) == [
        ("checkin", "Q-15 times", 1),
        ("instructor", "Q-05 nif", 2),
        ("instructor", "Q-06 phone", 2),
        ("member", "Q-08 gender", 4),
        ("payment", "Q-14 amount", 2),
        ("payment", "Q-14 date", 1),
        ("users", "Q-03 email", 2),
        ("users", "Q-04 name", 2),
        ("users", "Q-04 password", 2),
    ]


def test_required_and_lengths(t):
    assert lines(rules.broken_rows(t, rules.REQUIRED)) == [
        ("member", "required:phone", 2), ("payment", "required:subscriptionid", 1)]
    assert lines(rules.broken_rows(t, rules.LENGTHS)) == [
        ("instructor", "length:nif", 2), ("member", "length:city", 5)]


def test_uniqueness_ignores_nulls(t):
    assert lines(rules.broken_uniqueness(t, composite=False)) == [
        ("member", "unique:nif", 2), ("member", "unique:userid", 3)]
    assert lines(rules.broken_uniqueness(t, composite=True)) == [
        ("membersubscription", "unique:memberid+isactive", 2)]


def test_references_ignore_nulls(t):
    assert lines(rules.broken_references(t)) == [
        ("payment", "reference:subscriptionid", 2),
        ("users", "reference:usertypeid", 2),
    ]


def test_counts_agree_with_lines(t):
    found = lines(rules.broken_rows(t, rules.REQUIRED + rules.LENGTHS + rules.CHECKS))
    found += lines(rules.broken_uniqueness(t, composite=False))
    found += lines(rules.broken_uniqueness(t, composite=True))
    found += lines(rules.broken_references(t))
    expected = {}
    for table, rule, _ in found:
        expected[table, rule] = expected.get((table, rule), 0) + 1
    counted = {(r["table_name"], r["rule"]): r["broken"] for r in dicts(rules.rule_counts(t))}
    assert counted == expected


def test_valid_and_rejects_are_all_rows(t):
    for name in TABLES:
        valid, rejects = check(t[name], rules.rules_of(name))
        assert valid.count() + rejects.count() == t[name].count()
    _, rejects = check(t["member"], rules.rules_of("member"))
    assert {r["memberid"]: r["rules"] for r in dicts(rejects)} == {
        2: ["required:phone"], 4: ["Q-08 gender"], 5: ["length:city"]}


def test_repeated_keys(spark, t):
    twice = t.with_tables(checkin=t["checkin"].unionByName(t["checkin"].where("checkinid = 1")))
    assert dicts(rules.repeated_keys(twice)) == [dict(table_name="checkin", row_id=1, surplus=1)]


def test_seed_rows(spark):
    for name, rows in SEED_ROWS.items():
        df = seed_table(spark, name, NOW)
        assert df.count() == len(rows) == 3
        assert [f.name for f in df.schema] == TABLES[name].names
        assert check(df, rules.rules_of(name))[1].count() == 0
    assert str(seed_table(spark, "plan", NOW).where("planid = 2").first()["monthlyprice"]) == "30.00"


def test_values_are_spread_by_their_number(spark, t, monkeypatch, capsys):
    from palestra.operators import checks

    monkeypatch.setattr(checks, "ROWS_PER_TASK", 1, raising=False)
    counts = rules.rule_counts(t)
    counts.explain()
    tasks = re.findall(r"hashpartitioning\(table_name#\d+, rule#\d+, value#\d+, (\d+)\)",
                       capsys.readouterr().out)
    assert tasks and int(tasks[0]) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    test_counts_agree_with_lines(t)
