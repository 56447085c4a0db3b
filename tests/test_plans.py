"""Shapes of physical plans, and joins on a key that holds a third of the rows."""

import contextlib
import datetime as dt
import io

import pytest
from conftest import HOUR
from pyspark.sql import functions as F

from palestra.asof import AsOf
from palestra.plans import app_queries as app
from palestra.plans import club_rules as rules
from palestra.plans import views
from palestra.plans.sql_functions import register_functions
from palestra.sources.buckets import with_buckets, write_buckets
from palestra.sources.fixture import FIXTURE_AS_OF, mapped_tables
from palestra.sources.schema import TABLES
from palestra.sources.tables import ClubTables, read_tables, write_table

SMALL = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@contextlib.contextmanager
def settings(spark, **values):
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The mapped tables written in their layout and read back."""
    root = str(tmp_path_factory.mktemp("stored"))
    mapped = mapped_tables(spark, SMALL)
    with settings(spark, spark__sql__shuffle__partitions="1"):
        for name in ("classschedule", "checkin", "payment", "classbooking", "member", "class",
                     "users", "instructor", "membersubscription", "plan"):
            write_table(mapped[name], name, f"{root}/{name}")
    return read_tables(spark, root)


def test_stored_tables_read_back(spark, stored):
    mapped = mapped_tables(spark, SMALL)
    for name in ("checkin", "classschedule", "payment"):
        assert stored[name].schema.names == TABLES[name].names
        assert stored[name].exceptAll(mapped[name]).isEmpty()
        assert stored[name].count() == mapped[name].count()


def test_dates_prune_partitions(stored):
    text = plan(views.dashboard_stats(stored, FIXTURE_AS_OF))
    assert "PartitionFilters: [isnotnull(date" in text.replace("\n", "")
    assert "(date#" in text and "= 2024-01-20)" in text
    text = plan(views.member_stats_month(stored, FIXTURE_AS_OF))
    assert ">= 2024-01-01), (date#" in text and ">= 2024-01-01)" in text
    assert "PushedFilters: [IsNotNull(bookingdate), GreaterThanOrEqual(bookingdate" in text
    assert "PushedFilters: [IsNotNull(isactive), EqualTo(isactive,true)" in text


def test_scans_read_only_needed_columns(stored):
    text = plan(views.member_stats_month(stored, FIXTURE_AS_OF))
    assert "ReadSchema: struct<memberid:bigint,entrancetime:bigint,exittime:bigint>" in text
    assert "ReadSchema: struct<memberid:bigint,userid:bigint,isactive:boolean>" in text


def test_top_rows_are_cut_before_the_shuffle(spark, stored):
    assert "TakeOrderedAndProject" in plan(app.latest_checkins(stored, FIXTURE_AS_OF))
    users = stored["users"].select("userid")
    text = plan(app.last_payments(stored, FIXTURE_AS_OF, users))
    assert text.count("WindowGroupLimit") >= 2


def test_without_broadcast_results_are_the_same(spark, monkeypatch):
    """The shuffle way that large days and user sets take."""
    path = "/root/testdata/sf0.01"
    t = mapped_tables(spark, path)
    users = t["users"].select("userid")
    runs = [
        lambda: app.bookable_classes(t, FIXTURE_AS_OF, 7),
        lambda: app.month_summary(t, FIXTURE_AS_OF, users),
    ]
    expected = [sorted(map(str, run().collect())) for run in runs]
    monkeypatch.setattr("palestra.plans.app_queries.fits", lambda df: False)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = plan(runs[0]())
        assert "SortMergeJoin LeftAnti" in text  # only the one member is broadcast
        assert [sorted(map(str, run().collect())) for run in runs] == expected


@pytest.fixture(scope="module")
def skewed(spark):
    """One member, one class and one subscription hold a third of the large tables."""
    n = 60_000
    hot = "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 2000 END"
    ids = spark.range(0, n, 1, 8)
    moment = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
    stamp = [f"{moment} AS created_at", f"{moment} AS updated_at"]
    frames = {
        "checkin": ids.selectExpr(
            "id AS checkinid", f"{hot} AS memberid", "date_add(DATE '2024-01-01', int(id % 25)) AS date",
            f"{HOUR} AS entrancetime", f"{HOUR} + id * 1000 AS exittime", *stamp),
        "classbooking": ids.selectExpr(
            "id AS bookingid", "id AS memberid", f"{hot} AS classscheduleid",
            "TIMESTAMP_NTZ '2024-01-05 00:00:00' AS bookingdate", *stamp),
        "payment": ids.selectExpr(
            "id AS paymentid", f"{hot} AS subscriptionid", "CAST(10 AS DECIMAL(10,2)) AS amount",
            "id % 5 = 1 AS ispayed", "date_add(DATE '2024-01-10', int(id % 25)) AS duedate",
            "CAST(NULL AS DATE) AS paymentdate", "'x' AS paymentmethod", "string(id) AS reference",
            *stamp),
        "classschedule": spark.range(2100).selectExpr(
            "id AS classscheduleid", "1 AS classid", "DATE '2024-01-21' AS date",
            f"{HOUR} AS starttime", f"{2 * HOUR} AS endtime", "10 AS maxparticipants",
            "true AS isactive", *stamp),
        "member": spark.range(n).selectExpr(
            "id AS memberid", "id AS userid", "'000000000' AS nif", "'1' AS phone", "'1' AS iban",
            "DATE '2024-01-01' AS registrationdate", "DATE '1990-01-01' AS birthdate",
            "'Outro' AS gender", "'a' AS address", "'c' AS city", "'p' AS postalcode",
            "true AS isactive", *stamp),
        "users": spark.range(n).selectExpr(
            "id AS userid", "string(id) AS email", "'12345678' AS password", "string(id) AS name",
            "3 AS usertypeid", "true AS isactive", "CAST(NULL AS TIMESTAMP_NTZ) AS last_login",
            "CAST(NULL AS TIMESTAMP_NTZ) AS password_changed_at", *stamp),
        "membersubscription": spark.range(2000).selectExpr(
            "id AS subscriptionid", "1 AS planid", "id AS memberid", "DATE '2024-01-01' AS startdate",
            "DATE '2025-01-01' AS enddate", "true AS isactive", *stamp),
        "class": spark.range(1, 2).selectExpr(
            "id AS classid", "id AS instructorid", "'k' AS name", "'' AS description",
            "'A' AS room", "10 AS capacity", "10 AS duration_minutes", "true AS isactive", *stamp),
        "instructor": spark.range(1, 2).selectExpr(
            "id AS instructorid", "id AS userid", "'1' AS nif", "'1' AS phone", "true AS isactive",
            *stamp),
        "plan": spark.range(1, 2).selectExpr(
            "int(id) AS planid", "'p' AS name", "CAST(20 AS DECIMAL(10,2)) AS monthlyprice",
            "true AS access24h", "'' AS description", "true AS isactive", *stamp),
    }
    return ClubTables(spark, {name: (lambda df=df: df) for name, df in frames.items()})


SPLIT_EARLY = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "8k",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "16k",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__shuffle__partitions": "8",
}


@pytest.mark.parametrize("view", [
    views.all_checkins, views.member_schedule_classes, views.member_account_details,
    views.member_checkin_history, views.member_payment_history,
])
def test_hot_keys_are_split(spark, skewed, view):
    plain = view(skewed, FIXTURE_AS_OF).collect()
    with settings(spark, **SPLIT_EARLY):
        df = view(skewed, FIXTURE_AS_OF)
        split = df.collect()
        # the adaptive plan is final only after the rows were asked for
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in text
    assert sorted(map(str, split)) == sorted(map(str, plain))


def test_hot_members_statistics(skewed):
    rows = {r["memberid"]: r for r in views.member_stats_month(skewed, FIXTURE_AS_OF).collect()}
    visits = [i for i in range(60_000) if (i % 3 == 0 or i % 2000 == 1) and i % 25 <= 19]
    unpaid = [i for i in range(60_000) if (i % 3 == 0 or i % 2000 == 1) and i % 5 != 1]
    assert rows[1]["checkin_count"] == len(visits)
    assert rows[1]["total_hours"] == sum(i * 1000 for i in visits) * len(unpaid) / HOUR


def test_latest_checkins_rank_null_days_first(spark):
    t = mapped_tables(spark, "/root/testdata/sf0.001")
    visits = t["checkin"].where("checkinid < 300")
    undated = visits.withColumn("date", F.when(F.col("checkinid") % 50 > 0, F.col("date")))
    tables = t.with_tables(checkin=undated)
    for k in (3, 10_000):
        rows = app.latest_checkins(tables, FIXTURE_AS_OF, k=k).collect()
        days = [r["date"] for r in rows]
        assert days == sorted(days, key=lambda d: (d is not None, -(d.toordinal() if d else 0)))
    assert days[0] is None


def test_mapping_follows_the_size_of_its_tables(spark):
    """No cap: schedules use all classes and classes all instructors, at any scale."""
    for path in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        t = mapped_tables(spark, path)
        used = t["classschedule"].select("classid").distinct().count()
        assert used >= 0.9 * t["class"].count()
        taught = t["class"].select("instructorid").distinct().count()
        assert taught == t["instructor"].count()
        lost = t["classbooking"].join(t["member"], "memberid", "left_anti")
        assert lost.isEmpty() and t["payment"].count() == spark.read.parquet(f"{path}/orders.parquet").count()


def test_settled_payments_need_no_join(spark):
    from palestra.catalog import job_queries

    text = job_queries()["m04_overdue_settled"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in text


def test_values_are_counted_in_one_pass(spark):
    t = mapped_tables(spark, "/root/testdata/sf0.001")
    text = rules.rule_counts(t)._jdf.queryExecution().optimizedPlan().toString()
    # users come from three inputs, so each scan of them shows three relations
    assert text.count("Relation") <= 3 * 2 * 14


def test_joins_in_buckets_need_no_shuffle(spark, tmp_path):
    mapped = mapped_tables(spark, SMALL)
    write_buckets(mapped, str(tmp_path), "bt_", 4)
    t = with_buckets(mapped, "bt_")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        for view in (views.all_checkins, views.payments, views.checkin_history_rows):
            text = plan(view(t, FIXTURE_AS_OF))
            assert "SortMergeJoin" in text and "Exchange" not in text and "Bucketed: true" in text, view
            rows = view(t, FIXTURE_AS_OF)
            assert rows.exceptAll(view(mapped, FIXTURE_AS_OF)).isEmpty()
            assert rows.count() == view(mapped, FIXTURE_AS_OF).count() > 0


def test_table_functions_equal_the_frames(spark, stored):
    register_functions(stored)
    for day in ("2024-01-20", "2023-11-05"):
        now = AsOf(dt.datetime.fromisoformat(f"{day} 07:30:15.250000"))
        for user in (7, 8, 10, 99999999):
            for call, frame in (
                (f"month_summary(TIMESTAMP_NTZ '{now.ts}', {user})", app.month_summary(stored, now, user)),
                (f"last_payments(DATE '{day}', {user})", app.last_payments(stored, now, user)),
            ):
                assert spark.sql(f"SELECT * FROM {call}").select(*frame.columns).collect() == frame.collect(), call
        frame = views.member_available_classes(stored, now)
        found = spark.sql(f"SELECT * FROM available_classes(TIMESTAMP_NTZ '{now.ts}')").select(*frame.columns)
        assert sorted(found.collect()) == sorted(frame.collect())
    assert spark.sql("SELECT * FROM last_payments(DATE '2024-01-20', NULL)").isEmpty()
