"""Texts as the member pages show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts the pages show.
NOTHING_DUE = "Pagamento em dia"
NO_VALUE = "N/A"
STILL_INSIDE = "Em curso"
PAID, OVERDUE, PENDING = "Pago", "Em Atraso", "Pendente"


def or_default(value: Column, default: str) -> Column:
    """The value, or the default where it is missing or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def date_text(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def money_text(amount: Column) -> Column:
    """An amount such as ``30.00€``; missing amounts read ``0.00€``."""
    cents = F.coalesce(amount, F.lit(0)).cast("decimal(12,2)")
    return F.concat(cents.cast("string"), F.lit("€"))


def rounded_hours(value: Column) -> Column:
    """Whole hours, halves to the even number; missing hours are 0."""
    return F.bround(F.coalesce(value, F.lit(0.0)), 0).cast("bigint")


def payment_status(paid: Column, due: Column, today: Column) -> Column:
    return F.when(paid, F.lit(PAID)).when(due < today, F.lit(OVERDUE)).otherwise(F.lit(PENDING))
