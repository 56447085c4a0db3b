"""Continuous intake: each micro-batch of requests runs an intake job on the stored tables.

The outcome of a batch is written to a folder of its own first, and marked as complete; then
its rows are merged into the tables by key. A batch that the stream repeats after a failure
takes the outcome that is there and merges it again, which changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from palestra.asof import AsOf
from palestra.operators.running import booking_deltas, merge_counts
from palestra.plans.bookings import book_classes
from palestra.plans.logins import apply_logins
from palestra.plans.registration import register_members
from palestra.session import workspace
from palestra.sources.stored import StoredTables
from palestra.sources.schema import TABLES
from palestra.sources.tables import ClubTables

REQUEST_SCHEMAS = {
    "signup": "request_id BIGINT, name STRING, password STRING, email STRING, nif STRING, "
    "phone STRING, iban STRING, birthdate STRING, gender STRING, address STRING, city STRING, "
    "postalcode STRING, plan STRING",
    "booking": "request_id STRING, userid BIGINT, classscheduleid BIGINT, "
    "requested_at TIMESTAMP_NTZ",
    "login": "userid BIGINT, logged_in_at TIMESTAMP_NTZ",
}


def _signups(t: ClubTables, as_of: AsOf, rows: DataFrame) -> dict[str, DataFrame]:
    done = register_members(t, as_of, rows)
    return {"users": done.users, "member": done.member,
            "membersubscription": done.membersubscription, "rejects": done.rejects}


def _bookings(t: ClubTables, as_of: AsOf, rows: DataFrame) -> dict[str, DataFrame]:
    done = book_classes(t, as_of, rows)
    return {"classbooking": done.classbooking, "rejects": done.rejects}


def _logins(t: ClubTables, as_of: AsOf, rows: DataFrame) -> dict[str, DataFrame]:
    done = apply_logins(t, as_of, rows)
    return {"users": done.changed, "rejects": done.rejects}


_JOBS = {"signup": _signups, "booking": _bookings, "login": _logins}


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _marked(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def _mark(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.create(where, True).close()


def take_in(
    store: StoredTables, kind: str, rows: DataFrame, batch: str, as_of: AsOf | None = None
) -> None:
    """Run one batch of requests, once."""
    spark = store.spark
    folder = f"{store.root}/intake/{kind}/{batch}"
    if _marked(spark, f"{folder}/_merged"):
        return
    if not _marked(spark, f"{folder}/_complete"):
        with workspace(spark):
            for name, df in _JOBS[kind](store.tables(), as_of or AsOf.now(), rows).items():
                df.write.mode("overwrite").parquet(f"{folder}/{name}")
        _mark(spark, f"{folder}/_complete")
    for name in TABLES:
        if _marked(spark, f"{folder}/{name}"):
            store.merge(name, spark.read.schema(TABLES[name].struct).parquet(f"{folder}/{name}"))
    if kind == "booking":
        made = spark.read.schema(TABLES["classbooking"].struct).parquet(f"{folder}/classbooking")
        merge_counts(store, batch, booking_deltas(added=made))
    _mark(spark, f"{folder}/_merged")


def rejects(store: StoredTables, kind: str) -> DataFrame:
    """What the batches so far have rejected, with the reason."""
    return store.spark.read.parquet(f"{store.root}/intake/{kind}/*/rejects")


def request_stream(spark: SparkSession, kind: str, folder: str) -> DataFrame:
    """Requests that arrive as JSON files in a folder."""
    return spark.readStream.schema(REQUEST_SCHEMAS[kind]).json(folder)


def start_intake(
    store: StoredTables,
    kind: str,
    requests: DataFrame,
    checkpoint: str,
    clock: Callable[[], AsOf] = AsOf.now,
    **trigger,
) -> StreamingQuery:
    """Start the intake of one kind of requests; ``trigger`` as for ``writeStream``."""

    def run(rows: DataFrame, batch_id: int) -> None:
        take_in(store, kind, rows, f"{kind}-{batch_id}", clock())

    writer = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
