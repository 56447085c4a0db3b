"""All queries and jobs by name, on the tables derived from the test data."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palestra.operators.cascades import change_batch, delete_batch
from palestra.operators.changes import change_keys, delete_rows, update_where, with_defaults
from palestra.operators.checks import check
from palestra.operators.differences import differences, redelivered
from palestra.operators.existence import build_filter, filter_bits
from palestra.operators.numbering import highest_key, numbered
from palestra.operators.running import booking_deltas, merge_counts, read_counts
from palestra.operators.text_index import write_postings
from palestra.plans import app_queries as app
from palestra.plans import club_rules as rules
from palestra.plans import screen_figures as figures
from palestra.plans import views
from palestra.plans.bookings import Bookings, book_classes
from palestra.plans.deliveries import take_delivery
from palestra.plans.logins import Logins, apply_logins
from palestra.plans.member_days import daily_visitors, member_days, month_visitors
from palestra.plans.registration import Registration, register_members
from palestra.sources.fixture import FIXTURE_AS_OF as AS_OF
from palestra.plans.sql_functions import register_functions
from palestra.session import application_folder, durable
from palestra.sources.buckets import with_buckets, write_buckets
from palestra.sources.fixture import delivered_tables, mapped_tables, requests
from palestra.sources.schema import TABLES
from palestra.sources.stored import StoredTables
from palestra.sources.tables import ClubTables

Query = Callable[[SparkSession, str], DataFrame]


def _view(view) -> Query:
    return lambda spark, sf_dir: view(mapped_tables(spark, sf_dir), AS_OF)


def _for_all_users(query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = mapped_tables(spark, sf_dir)
        return query(t, AS_OF, t["users"].select("userid"))

    return run


# The member, and the instructor, that the queries for one user are asked for.
ONE_USER, ONE_INSTRUCTOR = 7, 10000003


def _for_one_user(query, user: int = ONE_USER) -> Query:
    return lambda spark, sf_dir: query(mapped_tables(spark, sf_dir), AS_OF, user)


def _for_some_users(query) -> Query:
    """For the users who sent a login request."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        senders = requests(spark, sf_dir, "login").select("userid").distinct()
        return query(mapped_tables(spark, sf_dir), AS_OF, senders)

    return run


def _for_signup_emails(query, *columns: str) -> Query:
    return lambda spark, sf_dir: query(
        mapped_tables(spark, sf_dir), AS_OF, requests(spark, sf_dir, "signup").select(*columns)
    )


def view_queries() -> dict[str, Query]:
    return {
        "v01_user_authentication": _view(views.user_authentication),
        "v02_email_exists": _view(views.email_exists),
        "v03_plan": _view(views.plan_choices),
        "v04_member_data": _view(views.member_data),
        "v05_member_stats_month": _view(views.member_stats_month),
        "v05_member_stats_month_corrected": _view(views.member_stats_month_corrected),
        "v06_member_schedule_classes": _view(views.member_schedule_classes),
        "v07_member_available_classes": _view(views.member_available_classes),
        "v09_member_account_details": _view(views.member_account_details),
        "v10_instructor_info": _view(views.instructor_info),
        "v11_instructor_classes": _view(views.instructor_classes),
        "v12_class_schedules": _view(views.class_schedules),
        "v13_dashboard_stats": _view(views.dashboard_stats),
        "v14_all_members": _view(views.all_members),
        "v15_all_classes": _view(views.all_classes),
        "v16_all_checkins": _view(views.all_checkins),
        "v17_machines": _view(views.machines),
        "v18_payments": _view(views.payments),
        "v19_plans": _view(views.plans),
        "v20_member_payment_history": _view(views.member_payment_history),
        "v21_member_checkin_history": _view(views.member_checkin_history),
    }


def app_query_set() -> dict[str, Query]:
    return {
        "d01_users_by_email": _for_signup_emails(app.users_by_email, "email"),
        "d02_registration_plans": _view(app.registration_plans),
        "d03_emails_taken": _for_signup_emails(app.emails_taken, "request_id", "email"),
        "d04_month_summary": _for_all_users(app.month_summary),
        "d05_booked_classes": _for_all_users(app.booked_classes),
        "d06_bookable_classes": _for_one_user(app.bookable_classes),
        "d07_account_details": _for_all_users(app.account_details),
        "d08_last_payments": _for_all_users(app.last_payments),
        "d09_last_visits": _for_all_users(app.last_visits),
        "d10_instructor_profile": _for_all_users(app.instructor_profile),
        "d11_taught_classes": _for_all_users(app.taught_classes),
        "d12_taught_schedules": _for_all_users(app.taught_schedules),
        "d13_dashboard": _view(app.dashboard),
        "d14_member_list": _view(app.member_list),
        "d15_class_list": _view(app.class_list),
        "d16_latest_checkins": _view(app.latest_checkins),
        "d17_machine_list": _view(app.machine_list),
        "d18_payment_list": _view(app.payment_list),
        "d19_plan_list": _view(app.plan_list),
        "d20_member_logins": _view(app.member_logins),
        "s05_all_bookings": _view(app.all_bookings),
        **{f"{name}_one": _for_one_user(query) for name, query in _OF_MEMBERS.items()},
        **{f"{name}_one": _for_one_user(query, ONE_INSTRUCTOR) for name, query in _OF_INSTRUCTORS.items()},
        **{f"{name}_some": _for_some_users(query) for name, query in _OF_MEMBERS.items()},
    }


_OF_MEMBERS = {
    "d04_month_summary": app.month_summary,
    "d05_booked_classes": app.booked_classes,
    "d07_account_details": app.account_details,
    "d08_last_payments": app.last_payments,
    "d09_last_visits": app.last_visits,
}
_OF_INSTRUCTORS = {
    "d10_instructor_profile": app.instructor_profile,
    "d11_taught_classes": app.taught_classes,
    "d12_taught_schedules": app.taught_schedules,
}


def _registration(spark: SparkSession, sf_dir: str) -> Registration:
    return register_members(
        mapped_tables(spark, sf_dir), AS_OF, requests(spark, sf_dir, "signup")
    )


def _bookings(spark: SparkSession, sf_dir: str) -> Bookings:
    """All booking requests, against the bookings made up to now."""
    t = mapped_tables(spark, sf_dir)
    stored = t["classbooking"].where(F.col("bookingdate") <= AS_OF.timestamp())
    return book_classes(
        t.with_tables(classbooking=stored), AS_OF, requests(spark, sf_dir, "booking")
    )


def _logins(spark: SparkSession, sf_dir: str) -> Logins:
    return apply_logins(mapped_tables(spark, sf_dir), AS_OF, requests(spark, sf_dir, "login"))


def _overdue_settled(t: ClubTables, as_of) -> DataFrame:
    """Mark every overdue payment as paid today."""
    overdue = ~F.col("ispayed") & (F.col("duedate") < as_of.today())
    return update_where(
        t["payment"], overdue, {"ispayed": F.lit(True), "paymentdate": as_of.today()}, as_of
    )


def _bare_checkins(t: ClubTables, as_of) -> DataFrame:
    """One more visit for every recorded one, given by key and member only."""
    top = highest_key(t["checkin"], "checkinid")
    given = t["checkin"].select((F.col("checkinid") + top + 1).alias("checkinid"), "memberid")
    return with_defaults(given, "checkin", as_of)


def _visits_numbered(t: ClubTables, as_of) -> DataFrame:
    visits = t["checkin"].select("checkinid", "date", "entrancetime")
    return numbered(visits, ["date", "entrancetime", "checkinid"])


def _inactive_users_deleted(t: ClubTables, as_of) -> DataFrame:
    gone = t["users"].where("NOT isactive").select("userid")
    after, _ = delete_rows(t, "users", gone, as_of)
    people = [
        after[name].select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), "userid",
                           "updated_at")
        for name, key in (("member", "memberid"), ("instructor", "instructorid"))
    ]
    return people[0].unionByName(people[1])


def _inactive_classes_refused(t: ClubTables, as_of) -> DataFrame:
    gone = t["class"].where("NOT isactive").select("classid")
    return delete_rows(t, "class", gone, as_of)[1]


def _inactive_classes_deleted(t: ClubTables, as_of) -> DataFrame:
    gone = t["class"].where("NOT isactive").select("classid")
    return delete_rows(t, "class", gone, as_of)[0]["class"]


def _instructors_renumbered(t: ClubTables, as_of) -> DataFrame:
    """Move active instructors to new keys; their classes follow."""
    renames = t["instructor"].where("isactive").select(
        F.col("instructorid").alias("old_key"), (F.col("instructorid") + 5000000).alias("new_key")
    )
    after, _ = change_keys(t, "instructor", renames, as_of)
    return after["class"].select(
        F.lit("class").alias("table_name"), F.col("classid").alias("row_id"), "instructorid",
        "updated_at",
    ).unionByName(
        after["instructor"].select(
            F.lit("instructor").alias("table_name"), F.col("userid").alias("row_id"),
            "instructorid", "updated_at",
        )
    )


def _own_folder(spark: SparkSession, name: str) -> str:
    """A new folder, which goes when the application ends."""
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _store(t: ClubTables, *names: str) -> StoredTables:
    """A new store that holds some of the tables."""
    store = StoredTables(t.spark, _own_folder(t.spark, "store"), unit="month")
    for name in names:
        store.create(name, t[name])
    return store


def _visits_inserted(t: ClubTables, as_of) -> DataFrame:
    store = _store(t, "checkin")
    store.insert("checkin", _bare_checkins(t, as_of))
    return store.read("checkin")


def _payments_settled(t: ClubTables, as_of) -> DataFrame:
    store = _store(t, "payment")
    overdue = store.read("payment").where(~F.col("ispayed") & (F.col("duedate") < as_of.today()))
    changes = overdue.select("paymentid", F.lit(True).alias("ispayed"), as_of.today().alias("paymentdate"))
    store.update("payment", changes, as_of)
    return store.read("payment")


def _visits_corrected(t: ClubTables, as_of) -> DataFrame:
    """Some visits move to the next day, some go and some come, in one batch."""
    store = _store(t, "checkin")
    moved = t["checkin"].where("checkinid % 50 = 7").withColumns(
        {"date": F.date_add("date", 1), "updated_at": as_of.timestamp()}
    )
    gone = t["checkin"].where("checkinid % 50 = 8").select("checkinid")
    store.merge("checkin", moved.unionByName(_bare_checkins(t, as_of)), gone)
    return store.read("checkin")


def _machines_after_recreation(t: ClubTables, as_of) -> DataFrame:
    """All tables dropped and created anew, the lookup rows loaded, the machines put back."""
    store = _store(t, "machine", "machinestatus")
    store.create_all(as_of)
    store.insert("machine", t["machine"])
    return views.machines(store.tables(), as_of)


def _members_again(spark: SparkSession, sf_dir: str) -> tuple[ClubTables, DataFrame]:
    """The member table as it comes again: some rows new, some changed, some missing."""
    t, given = mapped_tables(spark, sf_dir), delivered_tables(spark, sf_dir)["member"]
    columns = [c for c in given.columns if not c.endswith("_at")]
    fresh = t["member"].where("memberid % 10 = 0").withColumns(
        {
            "memberid": F.col("memberid") + 50000000,
            "nif": F.lpad((F.col("memberid") + 50000000).cast("string"), 9, "0"),
            "userid": F.lit(None).cast("bigint"),
        }
    )
    return t, given.where("memberid % 23 <> 5").select(*columns).unionByName(fresh.select(*columns))


def _member_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, again = _members_again(spark, sf_dir)
    return differences(t["member"], again, "memberid")


def _members_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, again = _members_again(spark, sf_dir)
    return redelivered(t["member"], again, "member", AS_OF)[0]


def _batch_deleted(t: ClubTables, as_of) -> tuple[ClubTables, DataFrame]:
    """Inactive members with their bookings, visits and unpaid subscriptions; inactive
    schedules; inactive plans and one that is in use."""
    members = t["member"].where("NOT isactive").select("memberid")
    of_members = lambda name: t[name].join(members, "memberid", "left_semi").select(TABLES[name].key)
    wanted = {name: of_members(name) for name in ("classbooking", "checkin", "membersubscription")}
    wanted |= {
        "member": members,
        "classschedule": t["classschedule"].where("NOT isactive").select("classscheduleid"),
        "plan": t["plan"].where("NOT isactive OR planid = 2").select("planid"),
    }
    return delete_batch(t, wanted, as_of)


def _batch_left(t: ClubTables, as_of) -> DataFrame:
    after, _ = _batch_deleted(t, as_of)
    names = ["checkin", "classbooking", "membersubscription", "classschedule", "plan", "member"]
    keys = [after[n].select(F.lit(n).alias("table_name"), F.col(TABLES[n].key).cast("bigint").alias("row_id")) for n in names]
    return reduce(DataFrame.unionByName, keys)


def _keys_changed(t: ClubTables, as_of) -> DataFrame:
    """Active members and schedules and one plan move to new keys; what points at them follows."""
    moved = lambda name, by: t[name].where("isactive").select(
        F.col(TABLES[name].key).alias("old_key"), (F.col(TABLES[name].key) + by).alias("new_key")
    )
    plan = t["plan"].where("planid < 100 AND planid % 3 = 2").select(
        F.col("planid").alias("old_key"), (F.col("planid") + 498).alias("new_key")
    )
    renames = {"member": moved("member", 50000000), "classschedule": moved("classschedule", 70000000), "plan": plan}
    after, _ = change_batch(t, renames, as_of)
    return after["classbooking"].select(
        F.lit("classbooking").alias("table_name"), F.col("bookingid").alias("row_id"), "memberid",
        F.col("classscheduleid").alias("other_key"), "updated_at",
    ).unionByName(
        after["membersubscription"].select(
            F.lit("membersubscription").alias("table_name"), F.col("subscriptionid").alias("row_id"), "memberid",
            F.col("planid").cast("bigint").alias("other_key"), "updated_at",
        )
    )


def _counts_kept(t: ClubTables, removed=None) -> StoredTables:
    """A store with the numbers of bookings after three batches of them; the last one takes
    some back."""
    store = _store(t)
    for k in range(3):
        added = t["classbooking"].where(F.col("bookingid") % 3 == k)
        merge_counts(store, f"batch-{k}", booking_deltas(added, removed if k == 2 else None))
    return store


def _running_counts(t: ClubTables, as_of) -> DataFrame:
    removed = t["classbooking"].where("memberid % 10 = 0")
    store = _counts_kept(t, removed)
    return read_counts(t.spark, store.root).select("classscheduleid", "booked")


def _available_running(t: ClubTables, as_of) -> DataFrame:
    return views.member_available_classes(t, as_of, read_counts(t.spark, _counts_kept(t).root))


def _emails_taken_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-03 with a stored filter of the emails in front of the exact join."""
    t = mapped_tables(spark, sf_dir)
    bits = filter_bits(t["users"].count())
    stored = durable(build_filter(t["users"], "email", bits))
    return app.emails_taken(
        t, AS_OF, requests(spark, sf_dir, "signup").select("request_id", "email"), (stored, bits)
    )


ROWS_PER_BUCKET = 1_000_000


def _in_buckets(view) -> Query:
    """A view on tables that are stored in buckets."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, prefix = mapped_tables(spark, sf_dir), f"b{uuid.uuid4().hex}_"
        buckets = max(4, t["checkin"].count() // ROWS_PER_BUCKET)
        write_buckets(t, _own_folder(spark, "buckets"), prefix, buckets)
        return view(with_buckets(t, prefix), AS_OF)

    return run


def _by_function(call: str) -> Query:
    """A table function in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_functions(mapped_tables(spark, sf_dir))
        return spark.sql(f"SELECT * FROM {call}")

    return run


def _members_by_index(text: str, **filters) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, index = mapped_tables(spark, sf_dir), _own_folder(spark, "postings")
        write_postings(t["users"], "userid", ["name", "email"], index)
        return figures.find_members(t, AS_OF, text=text, index=index, **filters)

    return run


_NOW = f"TIMESTAMP_NTZ '{AS_OF.ts}'"


def job_queries() -> dict[str, Query]:
    return {
        "m01_new_users": lambda s, d: _registration(s, d).users,
        "m01_new_members": lambda s, d: _registration(s, d).member,
        "m01_new_subscriptions": lambda s, d: _registration(s, d).membersubscription,
        "m01_signup_rejects": lambda s, d: _registration(s, d).rejects,
        "m02_new_bookings": lambda s, d: _bookings(s, d).classbooking,
        "m02_booking_rejects": lambda s, d: _bookings(s, d).rejects,
        "m03_users_after_logins": lambda s, d: _logins(s, d).users,
        "m03_login_rejects": lambda s, d: _logins(s, d).rejects,
        "m04_overdue_settled": _view(_overdue_settled),
        "m05_checkin_defaults": _view(_bare_checkins),
        "m06_visits_numbered": _view(_visits_numbered),
        "m07_inactive_users_deleted": _view(_inactive_users_deleted),
        "m07_inactive_classes_refused": _view(_inactive_classes_refused),
        "m07_inactive_classes_deleted": _view(_inactive_classes_deleted),
        "m07_instructors_renumbered": _view(_instructors_renumbered),
        "s06_visits_inserted": _view(_visits_inserted),
        "s07_payments_settled": _view(_payments_settled),
        "s07_visits_corrected": _view(_visits_corrected),
        "s08_machines_after_recreation": _view(_machines_after_recreation),
        "m04_member_differences": _member_differences,
        "m04_members_redelivered": _members_redelivered,
        "m07_batch_left": _view(_batch_left),
        "m07_batch_refused": _view(lambda t, a: _batch_deleted(t, a)[1]),
        "m07_keys_changed": _view(_keys_changed),
        "a05_running_counts": _view(_running_counts),
        "v07_available_classes_running": _view(_available_running),
        "d03_emails_taken_filtered": _emails_taken_filtered,
        "v16_all_checkins_bucketed": _in_buckets(views.all_checkins),
        "v18_payments_bucketed": _in_buckets(views.payments),
        "v21_checkin_history_bucketed": _in_buckets(views.checkin_history_rows),
        "v05_member_stats_from_days": _view(
            lambda t, a: views.member_stats_month(t, a, durable(member_days(t)))
        ),
        "x03_month_visitors": _view(lambda t, a: month_visitors(durable(daily_visitors(t)))),
        "v07_available_classes_sql": _by_function(f"available_classes({_NOW})"),
        "d04_month_summary_sql": _by_function(f"month_summary({_NOW}, {ONE_USER})"),
        "d08_last_payments_sql": _by_function(f"last_payments(DATE '{AS_OF.date}', {ONE_USER})"),
    }


def _on_delivery(find) -> Query:
    return lambda spark, sf_dir: find(delivered_tables(spark, sf_dir))


def _check(prefix: str) -> Query:
    return _on_delivery(lambda t: rules.broken_checks(t, prefix))


def _taken(spark: SparkSession, sf_dir: str, name: str):
    delivered = delivered_tables(spark, sf_dir)[name]
    return take_delivery(delivered, name, _own_folder(spark, f"delivery-{name}"))


def _delivery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [_taken(spark, sf_dir, name).counts for name in TABLES])


def _rejected_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = _taken(spark, sf_dir, "member").rejects
    return rejects.select("memberid", F.size("rules").cast("bigint").alias("rules"))


def _sent_twice(t: ClubTables) -> ClubTables:
    """Deliveries of which some rows came again, some of them twice."""
    again = {}
    for name, table in TABLES.items():
        late = t[name].where(F.col(table.key) % 11 == 0)
        again[name] = t[name].unionByName(late).unionByName(late.where(F.col(table.key) % 33 == 0))
    return t.with_tables(**again)


def _delivered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.broken_references(delivered_tables(spark, sf_dir), mapped_tables(spark, sf_dir))


def rule_queries() -> dict[str, Query]:
    return {
        "q01_labels": _check("Q-01"),
        "q02_plans": _check("Q-02"),
        "q03_emails": _check("Q-03"),
        "q04_users": _check("Q-04"),
        "q05_nifs": _check("Q-05"),
        "q06_phones": _check("Q-06"),
        "q07_ibans": _check("Q-07"),
        "q08_genders": _check("Q-08"),
        "q09_machines": _check("Q-09"),
        "q10_classes": _check("Q-10"),
        "q11_subscriptions": _check("Q-11"),
        "q12_schedules": _check("Q-12"),
        "q13_maintenance": _check("Q-13"),
        "q14_payments": _check("Q-14"),
        "q15_visits": _check("Q-15"),
        "q_required": _on_delivery(lambda t: rules.broken_rows(t, rules.REQUIRED)),
        "q_lengths": _on_delivery(lambda t: rules.broken_rows(t, rules.LENGTHS)),
        "q_unique": _on_delivery(lambda t: rules.broken_uniqueness(t, composite=False)),
        "q_unique_composite": _on_delivery(lambda t: rules.broken_uniqueness(t, composite=True)),
        "q_references": _delivered_references,
        "q_rule_counts": _on_delivery(rules.rule_counts),
        "q_repeated_keys": _on_delivery(lambda t: rules.repeated_keys(_sent_twice(t))),
        "q_delivery_counts": _delivery_counts,
        "q_rejected_members": _rejected_members,
        "q_valid_members": _on_delivery(
            lambda t: check(t["member"], rules.rules_of("member"))[0]
        ),
    }


GRID_ROOMS = ["Brand#1", "Brand#5", "Brand#12", "Brand#20"]


def figure_queries() -> dict[str, Query]:
    return {
        "x01_monthly_revenue": _view(figures.monthly_revenue),
        "x02_payment_states": _view(figures.payment_states),
        "x03_visits_today": _view(figures.visits_today),
        "x04_busiest_half_hours": _view(figures.busiest_half_hours),
        "x05_members_per_plan": _view(figures.members_per_plan),
        "x06_plan_performance": _view(figures.plan_performance),
        "x07_machines_per_status": _view(figures.machines_per_status),
        "x08_class_grid_cells": _view(figures.class_grid_cells),
        "x08_class_grid": _view(lambda t, a: figures.class_grid(t, a, GRID_ROOMS)),
        "x09_instructor_month": _view(figures.instructor_month),
        "x10_find_members": _view(
            lambda t, a: figures.find_members(t, a, text="9", active=True, plan="Premium")
        ),
        "x10_find_members_indexed": _members_by_index("0004", active=True),
        "x10_find_members_indexed_short": _members_by_index("#0", plan="Premium"),
        "x10_find_payments": _view(
            lambda t, a: figures.find_payments(
                t, a, text="7", status="Em Atraso", plan="Basico", since=a.date.replace(year=2022),
                until=a.date,
            )
        ),
        "x10_find_checkins": _view(
            lambda t, a: figures.find_checkins(t, a, text="1", day=a.date, inside=True)
        ),
        "x10_find_classes": _view(
            lambda t, a: figures.find_classes(
                t, a, instructor="Supplier#000000003", room="Brand#5"
            )
        ),
        "x10_find_machines": _view(
            lambda t, a: figures.find_machines(
                t, a, text="ring", kind="LARGE", status="Em funcionamento"
            )
        ),
    }


def queries() -> dict[str, Query]:
    return {
        **view_queries(), **app_query_set(), **job_queries(), **rule_queries(), **figure_queries(),
    }
