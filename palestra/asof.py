"""The clock of a query, passed in so that results repeat."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from palestra.functions.clock import MICROS_PER_SECOND


@dataclass(frozen=True)
class AsOf:
    """A moment in UTC. Query code takes date, time and month from here."""

    ts: dt.datetime

    def __post_init__(self):
        if self.ts.tzinfo is not None:
            utc = self.ts.astimezone(dt.timezone.utc).replace(tzinfo=None)
            object.__setattr__(self, "ts", utc)

    @classmethod
    def now(cls) -> AsOf:
        return cls(dt.datetime.now(dt.timezone.utc))

    @property
    def date(self) -> dt.date:
        return self.ts.date()

    @property
    def time_us(self) -> int:
        """Microseconds since midnight."""
        midnight = dt.datetime.combine(self.date, dt.time())
        return round((self.ts - midnight).total_seconds() * MICROS_PER_SECOND)

    def today(self) -> Column:
        return F.lit(self.date)

    def month_start(self) -> Column:
        return F.lit(self.date.replace(day=1))

    def timestamp(self) -> Column:
        # lit(datetime) would be bound to the session zone
        return F.lit(self.ts.isoformat(sep=" ")).cast("timestamp_ntz")

    def month_start_timestamp(self) -> Column:
        return self.month_start().cast("timestamp_ntz")
