"""The club's data rules, and jobs that find the rows that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palestra.operators.checks import (
    RowRule,
    key_violations,
    reference_violations,
    row_counts,
    row_violations,
    unique_violations,
    value_counts,
    value_rows,
)
from palestra.sources.schema import REFERENCES, TABLES
from palestra.sources.tables import ClubTables

# Limits, lists and patterns of the club's rules. \z is the end of the text;
# $ would let a final newline pass.
USER_TYPE_LABELS = ["Gestor", "Instrutor", "Membro"]
GENDERS = ["Masculino", "Feminino", "Outro"]
EMAIL_PATTERN = r"(?i)^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"
NIF_PATTERN = r"^[0-9]{9}\z"
PHONE_PATTERN = r"^[0-9+\-\s()]+\z"
MIN_PASSWORD = 8
IBAN_LENGTHS = (15, 34)
MAX_CAPACITY = 100
MAX_DURATION = 180


def _filled(column: str) -> Column:
    return F.length(F.trim(column)) > 0


CHECKS = [
    RowRule("Q-01 label", "usertype", lambda: F.col("label").isin(USER_TYPE_LABELS)),
    RowRule("Q-02 name", "plan", lambda: _filled("name")),
    RowRule("Q-02 price", "plan", lambda: F.col("monthlyprice") >= 0),
    RowRule("Q-03 email", "users", lambda: F.col("email").rlike(EMAIL_PATTERN)),
    RowRule("Q-04 password", "users", lambda: F.length("password") >= MIN_PASSWORD),
    RowRule("Q-04 name", "users", lambda: _filled("name")),
    RowRule("Q-05 nif", "instructor", lambda: F.col("nif").rlike(NIF_PATTERN)),
    RowRule("Q-05 nif", "member", lambda: F.col("nif").rlike(NIF_PATTERN)),
    RowRule("Q-06 phone", "instructor", lambda: F.col("phone").rlike(PHONE_PATTERN)),
    RowRule("Q-06 phone", "member", lambda: F.col("phone").rlike(PHONE_PATTERN)),
    RowRule("Q-07 iban", "member", lambda: F.length("iban").between(*IBAN_LENGTHS)),
    RowRule("Q-08 gender", "member", lambda: F.col("gender").isin(GENDERS)),
    RowRule("Q-09 name", "machine", lambda: _filled("name")),
    RowRule("Q-09 maintenance", "machine",
            lambda: F.col("maintenancedate") >= F.col("installationdate")),
    RowRule("Q-10 name", "class", lambda: _filled("name")),
    RowRule("Q-10 room", "class", lambda: _filled("room")),
    RowRule("Q-10 capacity", "class", lambda: F.col("capacity").between(1, MAX_CAPACITY)),
    RowRule("Q-10 duration", "class", lambda: F.col("duration_minutes").between(1, MAX_DURATION)),
    RowRule("Q-11 dates", "membersubscription", lambda: F.col("enddate") >= F.col("startdate")),
    RowRule("Q-12 places", "classschedule", lambda: F.col("maxparticipants") > 0),
    RowRule("Q-12 times", "classschedule", lambda: F.col("endtime") > F.col("starttime")),
    RowRule("Q-13 description", "machinemaintenancelog", lambda: _filled("description")),
    RowRule("Q-13 technician", "machinemaintenancelog", lambda: _filled("technician")),
    RowRule("Q-13 cost", "machinemaintenancelog", lambda: F.col("cost") >= 0),
    RowRule("Q-14 amount", "payment", lambda: F.col("amount") > 0),
    RowRule("Q-14 date", "payment", lambda: F.col("paymentdate") >= F.col("duedate")),
    RowRule("Q-15 times", "checkin", lambda: F.col("exittime") > F.col("entrancetime")),
]

REQUIRED = [
    RowRule(f"required:{c.name}", t.name, lambda c=c: F.col(c.name).isNotNull())
    for t in TABLES.values()
    for c in t.columns
    if c.required
]

# Spaces beyond the limit are cut off without complaint when a text is stored.
LENGTHS = [
    RowRule(
        f"length:{c.name}", t.name, lambda c=c: F.length(F.rtrim(c.name)) <= c.max_length
    )
    for t in TABLES.values()
    for c in t.columns
    if c.max_length is not None
]


def rules_of(table: str, *groups: list[RowRule]) -> list[RowRule]:
    """A table's row rules: required columns, lengths and checks, or only some groups."""
    return [r for group in groups or (REQUIRED, LENGTHS, CHECKS) for r in group if r.table == table]


def stored_text(table: str, column: str) -> Column:
    """A text as the table stores it: spaces beyond the column's length are cut off. A text
    that is too long in other ways stays, and breaks the length rule."""
    length = TABLES[table].column(column).max_length
    fits = F.length(F.rtrim(column)) <= length
    return F.when(fits, F.substring(column, 1, length)).otherwise(F.col(column))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def broken_rows(t: ClubTables, rules: list[RowRule]) -> DataFrame:
    """Broken row rules, one line per rule and row; each table is read once."""
    tables = list(dict.fromkeys(r.table for r in rules))
    return _union(
        [row_violations(t[name], name, [r for r in rules if r.table == name]) for name in tables]
    )


def broken_checks(t: ClubTables, prefix: str) -> DataFrame:
    """Rows that break the checks whose name starts with a rule number, such as Q-05."""
    return broken_rows(t, [r for r in CHECKS if r.rule.startswith(prefix)])


def broken_uniqueness(t: ClubTables, composite: bool) -> DataFrame:
    """Later holders of values that may occur once; of one column or of several together."""
    return _union(
        [
            unique_violations(t[table.name], table.name, columns)
            for table in TABLES.values()
            for columns in table.unique
            if (len(columns) > 1) == composite
        ]
    )


def repeated_keys(t: ClubTables) -> DataFrame:
    return _union([key_violations(t[name], name) for name in TABLES])


def broken_references(t: ClubTables, parents: ClubTables | None = None) -> DataFrame:
    """Rows whose reference has no target, within one set of tables or against another."""
    parents = parents or t
    return _union([reference_violations(t[r.child], r, parents[r.parent]) for r in REFERENCES])


def rule_counts(t: ClubTables) -> DataFrame:
    """How many rows break each rule of every kind; rules that hold are left out."""
    counts = [row_counts(t[name], name, rules_of(name)) for name in TABLES]
    judged = {r.child for r in REFERENCES} | {r.parent for r in REFERENCES}
    judged |= {table.name for table in TABLES.values() if table.unique}
    values = [value_rows(t[name], name, tuple(REFERENCES)) for name in TABLES if name in judged]
    counts.append(value_counts(_union(values)))
    total = _union(counts).groupBy("table_name", "rule").agg(F.sum("broken").alias("broken"))
    return total.where("broken > 0")
