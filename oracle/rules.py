"""The data rules in DuckDB SQL: each names the rows that break it."""

from oracle.mapping import sql
from palestra.sources.schema import REFERENCES, TABLES

# rule -> (table, condition that a row breaks)
BROKEN = [
    ("Q-01 label", "usertype", "label NOT IN ('Gestor', 'Instrutor', 'Membro')"),
    ("Q-02 name", "plan", "trim(name, ' ') = ''"),
    ("Q-02 price", "plan", "monthlyprice < 0"),
    ("Q-03 email", "users",
     r"NOT regexp_full_match(email, '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', 'i')"),
    ("Q-04 password", "users", "length(password) < 8"),
    ("Q-04 name", "users", "trim(name, ' ') = ''"),
    ("Q-05 nif", "instructor", "NOT regexp_full_match(nif, '[0-9]{9}')"),
    ("Q-05 nif", "member", "NOT regexp_full_match(nif, '[0-9]{9}')"),
    ("Q-06 phone", "instructor", r"NOT regexp_full_match(phone, '[-0-9+() \t\n]+')"),
    ("Q-06 phone", "member", r"NOT regexp_full_match(phone, '[-0-9+() \t\n]+')"),
    ("Q-07 iban", "member", "length(iban) < 15 OR length(iban) > 34"),
    ("Q-08 gender", "member", "gender NOT IN ('Masculino', 'Feminino', 'Outro')"),
    ("Q-09 name", "machine", "trim(name, ' ') = ''"),
    ("Q-09 maintenance", "machine", "maintenancedate < installationdate"),
    ("Q-10 name", "class", "trim(name, ' ') = ''"),
    ("Q-10 room", "class", "trim(room, ' ') = ''"),
    ("Q-10 capacity", "class", "capacity <= 0 OR capacity > 100"),
    ("Q-10 duration", "class", "duration_minutes <= 0 OR duration_minutes > 180"),
    ("Q-11 dates", "membersubscription", "enddate < startdate"),
    ("Q-12 places", "classschedule", "maxparticipants <= 0"),
    ("Q-12 times", "classschedule", "endtime <= starttime"),
    ("Q-13 description", "machinemaintenancelog", "trim(description, ' ') = ''"),
    ("Q-13 technician", "machinemaintenancelog", "trim(technician, ' ') = ''"),
    ("Q-13 cost", "machinemaintenancelog", "cost < 0"),
    ("Q-14 amount", "payment", "amount <= 0"),
    ("Q-14 date", "payment", "paymentdate < duedate"),
    ("Q-15 times", "checkin", "exittime <= entrancetime"),
]
REQUIRED = [
    (f"required:{c.name}", t.name, f"{c.name} IS NULL")
    for t in TABLES.values() for c in t.columns if c.required
]
LENGTHS = [
    (f"length:{c.name}", t.name, f"length(rtrim({c.name}, ' ')) > {c.max_length}")
    for t in TABLES.values() for c in t.columns if c.max_length is not None
]


def _lines(rules) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{rule}' AS rule,"
        f" CAST({TABLES[table].key} AS BIGINT) AS row_id FROM d_{table} WHERE {broken}"
        for rule, table, broken in rules
    )


def _unique(composite: bool) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{t.name}' AS table_name, 'unique:{"+".join(u)}' AS rule,
                   CAST(row_id AS BIGINT) AS row_id
            FROM (SELECT {t.key} AS row_id, row_number() OVER (
                      PARTITION BY {", ".join(u)} ORDER BY {t.key}) AS turn
                  FROM d_{t.name} WHERE {" AND ".join(f"{c} IS NOT NULL" for c in u)})
            WHERE turn > 1"""
        for t in TABLES.values() for u in t.unique if (len(u) > 1) == composite
    )


def _references(parents: str) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{r.child}' AS table_name, 'reference:{r.column}' AS rule,
                   CAST({TABLES[r.child].key} AS BIGINT) AS row_id
            FROM d_{r.child} c
            WHERE {r.column} IS NOT NULL AND NOT EXISTS (
                SELECT 1 FROM {parents}{r.parent} p
                WHERE p.{TABLES[r.parent].key} = c.{r.column})"""
        for r in REFERENCES
    )


_ALL = "\nUNION ALL ".join(
    [_lines(REQUIRED + LENGTHS + BROKEN), _unique(False), _unique(True), _references("d_")]
)
_NAMES = {
    "q01_labels": "Q-01", "q02_plans": "Q-02", "q03_emails": "Q-03", "q04_users": "Q-04",
    "q05_nifs": "Q-05", "q06_phones": "Q-06", "q07_ibans": "Q-07", "q08_genders": "Q-08",
    "q09_machines": "Q-09", "q10_classes": "Q-10", "q11_subscriptions": "Q-11",
    "q12_schedules": "Q-12", "q13_maintenance": "Q-13", "q14_payments": "Q-14",
    "q15_visits": "Q-15",
}
_MEMBER_RULES = [r for r in REQUIRED + LENGTHS + BROKEN if r[1] == "member"]

BODIES = {
    **{name: _lines([r for r in BROKEN if r[0].startswith(p)]) for name, p in _NAMES.items()},
    "q_required": _lines(REQUIRED),
    "q_lengths": _lines(LENGTHS),
    "q_unique": _unique(False),
    "q_unique_composite": _unique(True),
    "q_references": _references("g_"),
    "q_rule_counts": f"""
        SELECT table_name, rule, count(*) AS broken FROM ({_ALL}) GROUP BY table_name, rule
    """,
    "q_valid_members": "SELECT * FROM d_member WHERE "
    + " AND ".join(f"coalesce(NOT ({broken}), true)" for _, _, broken in _MEMBER_RULES),
    "q_delivery_counts": f"""
        SELECT table_name, rule, count(*) AS broken
        FROM ({_lines(REQUIRED + LENGTHS + BROKEN)}) GROUP BY table_name, rule
    """,
    "q_rejected_members": f"""
        SELECT row_id AS memberid, count(*) AS rules FROM ({_lines(_MEMBER_RULES)}) GROUP BY row_id
    """,
    "q_repeated_keys": "\nUNION ALL ".join(
        f"SELECT '{t.name}' AS table_name, CAST({t.key} AS BIGINT) AS row_id,"
        f" CAST(if({t.key} % 33 = 0, 2, 1) AS BIGINT) AS surplus FROM d_{t.name} WHERE {t.key} % 11 = 0"
        for t in TABLES.values()
    ),
}

ORACLE = {name: sql(body) for name, body in BODIES.items()}
