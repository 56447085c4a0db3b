"""The club's tables: columns, keys, references and insert defaults.

Times of day are BIGINT microseconds since midnight, because Parquet cannot hold
Spark's TIME type with default settings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "time": T.LongType(),
    "money": T.DecimalType(10, 2),
    "timestamp": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    required: bool = True
    max_length: int | None = None
    # a literal, or "today", "time" or "now" for the clock of the insert
    default: object = None

    @property
    def spark_type(self) -> T.DataType:
        return _TYPES[self.kind]


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    unique: tuple[tuple[str, ...], ...] = ()

    @property
    def key(self) -> str:
        return self.columns[0].name

    @property
    def struct(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c.name, c.spark_type, not c.required) for c in self.columns]
        )

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


@dataclass(frozen=True)
class Reference:
    """``child.column`` points at the key of ``parent``."""

    child: str
    column: str
    parent: str
    on_delete: str = "restrict"


def _text(name, length=None, required=True, default=None):
    return Column(name, "string", required, length, default)


_ACTIVE = Column("isactive", "boolean", default=True)
_CREATED = Column("created_at", "timestamp", required=False, default="now")
_STAMPS = (_CREATED, Column("updated_at", "timestamp", required=False, default="now"))

# Names, types, lengths and defaults follow the club's table definitions.
TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table(
            "usertype",
            (Column("usertypeid", "int"), _text("label", 50), *_STAMPS),
            unique=(("label",),),
        ),
        Table(
            "machinestatus",
            (Column("machinestatusid", "int"), _text("status", 30), *_STAMPS),
            unique=(("status",),),
        ),
        Table(
            "plan",
            (
                Column("planid", "int"),
                _text("name", 80),
                Column("monthlyprice", "money"),
                Column("access24h", "boolean", default=False),
                _text("description", required=False),
                _ACTIVE,
                *_STAMPS,
            ),
            unique=(("name",),),
        ),
        Table(
            "users",
            (
                Column("userid", "bigint"),
                _text("email", 254),
                _text("password", 255),
                _text("name", 120),
                Column("usertypeid", "int"),
                _ACTIVE,
                Column("last_login", "timestamp", required=False),
                Column("password_changed_at", "timestamp", required=False, default="now"),
                *_STAMPS,
            ),
            unique=(("email",),),
        ),
        Table(
            "instructor",
            (
                Column("instructorid", "bigint"),
                Column("userid", "bigint", required=False),
                _text("nif", 9),
                _text("phone", 15, required=False),
                _ACTIVE,
                *_STAMPS,
            ),
            unique=(("userid",), ("nif",)),
        ),
        Table(
            "member",
            (
                Column("memberid", "bigint"),
                Column("userid", "bigint", required=False),
                _text("nif", 9),
                _text("phone", 15),
                _text("iban", 34),
                Column("registrationdate", "date", default="today"),
                Column("birthdate", "date"),
                _text("gender", 10, required=False),
                _text("address", 255),
                _text("city", 100),
                _text("postalcode", 20),
                _ACTIVE,
                *_STAMPS,
            ),
            unique=(("userid",), ("nif",)),
        ),
        Table(
            "machine",
            (
                Column("machineid", "bigint"),
                Column("machinestatusid", "int"),
                _text("name", 100),
                _text("type", 50),
                _text("manufacturer", 100, required=False),
                _text("model", 100, required=False),
                _text("serialnumber", 50, required=False),
                Column("installationdate", "date", default="today"),
                Column("maintenancedate", "date"),
                *_STAMPS,
            ),
            unique=(("serialnumber",),),
        ),
        Table(
            "class",
            (
                Column("classid", "bigint"),
                Column("instructorid", "bigint"),
                _text("name", 80),
                _text("description", required=False),
                _text("room", 20),
                Column("capacity", "int"),
                Column("duration_minutes", "int", required=False),
                _ACTIVE,
                *_STAMPS,
            ),
        ),
        Table(
            "membersubscription",
            (
                Column("subscriptionid", "bigint"),
                Column("planid", "int"),
                Column("memberid", "bigint"),
                Column("startdate", "date", default="today"),
                Column("enddate", "date"),
                _ACTIVE,
                *_STAMPS,
            ),
            unique=(("memberid", "isactive"),),
        ),
        Table(
            "classschedule",
            (
                Column("classscheduleid", "bigint"),
                Column("classid", "bigint"),
                Column("date", "date"),
                Column("starttime", "time"),
                Column("endtime", "time"),
                Column("maxparticipants", "int", required=False),
                _ACTIVE,
                *_STAMPS,
            ),
            unique=(("classid", "date", "starttime"),),
        ),
        Table(
            "machinemaintenancelog",
            (
                Column("logid", "bigint"),
                Column("machineid", "bigint"),
                Column("maintenancedate", "date", default="today"),
                _text("description"),
                _text("technician", 80),
                Column("cost", "money"),
                _text("maintenancetype", 50, default="ROUTINE"),
                _CREATED,
            ),
        ),
        Table(
            "payment",
            (
                Column("paymentid", "bigint"),
                Column("subscriptionid", "bigint"),
                Column("amount", "money"),
                Column("ispayed", "boolean", default=False),
                Column("duedate", "date"),
                Column("paymentdate", "date", required=False),
                _text("paymentmethod", 50, required=False),
                _text("reference", 100, required=False),
                *_STAMPS,
            ),
            unique=(("reference",),),
        ),
        Table(
            "classbooking",
            (
                Column("bookingid", "bigint"),
                Column("memberid", "bigint"),
                Column("classscheduleid", "bigint"),
                Column("bookingdate", "timestamp", default="now"),
                *_STAMPS,
            ),
            unique=(("memberid", "classscheduleid"),),
        ),
        Table(
            "checkin",
            (
                Column("checkinid", "bigint"),
                Column("memberid", "bigint"),
                Column("date", "date", default="today"),
                Column("entrancetime", "time", default="time"),
                Column("exittime", "time", required=False),
                *_STAMPS,
            ),
        ),
    )
}

REFERENCES: tuple[Reference, ...] = (
    Reference("users", "usertypeid", "usertype"),
    Reference("instructor", "userid", "users", on_delete="set null"),
    Reference("member", "userid", "users", on_delete="set null"),
    Reference("machine", "machinestatusid", "machinestatus"),
    Reference("class", "instructorid", "instructor"),
    Reference("membersubscription", "memberid", "member"),
    Reference("membersubscription", "planid", "plan"),
    Reference("classschedule", "classid", "class"),
    Reference("machinemaintenancelog", "machineid", "machine"),
    Reference("payment", "subscriptionid", "membersubscription"),
    Reference("classbooking", "memberid", "member"),
    Reference("classbooking", "classscheduleid", "classschedule"),
    Reference("checkin", "memberid", "member"),
)

# Storage layout by how the queries filter: the date-driven tables are cut by date,
# so "today" and "this month" read only their own directories.
PARTITION_COLUMNS = {"classschedule": ["date"], "checkin": ["date"], "payment": ["duedate"]}
SORT_COLUMNS = {
    "classschedule": ["starttime"],
    "checkin": ["memberid"],
    "payment": ["subscriptionid"],
    "classbooking": ["bookingdate"],
}
