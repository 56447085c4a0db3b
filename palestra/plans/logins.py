"""Intake of login events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palestra.asof import AsOf
from palestra.operators.joins import Hint, fits, rows_for
from palestra.session import durable
from palestra.sources.tables import ClubTables


@dataclass(frozen=True)
class Logins:
    users: DataFrame
    changed: DataFrame
    rejects: DataFrame


def apply_logins(t: ClubTables, as_of: AsOf, events: DataFrame) -> Logins:
    """Set each user's last login from events (``userid``, ``logged_in_at``). A batch that
    comes late or twice never moves a login back. Unknown users are rejected.

    ``users`` is the whole new version, ``changed`` its rows that the batch touched.
    """
    latest = durable(events.groupBy("userid").agg(F.max("logged_in_at").alias("_latest")))
    hint = Hint(fits(latest))

    def after(how: str) -> DataFrame:
        joined = t["users"].join(hint(latest), "userid", how)
        touched = F.col("_latest").isNotNull()
        return joined.withColumns(
            {
                "last_login": F.greatest("last_login", "_latest"),
                "updated_at": F.when(touched, as_of.timestamp()).otherwise(F.col("updated_at")),
            }
        ).select(*t["users"].columns)

    known = rows_for(t["users"].select("userid"), latest, ["userid"], hint)
    unknown = latest.join(hint(known), "userid", "left_anti")
    reason = F.concat(F.lit("User with ID "), F.col("userid").cast("string"), F.lit(" not found"))
    return Logins(after("left"), after("inner"), unknown.select("userid", reason.alias("reason")))
