"""The mapped tables as DuckDB CTEs, and the clock of the tests as SQL literals."""

from __future__ import annotations

import re

from palestra.sources.fixture import DELIVERIES, MAPPING, REQUESTS, render

DIALECT = {"[[TS]]": "TIMESTAMP", "[[TIME_OF_DAY]]": "epoch_us(ts) % 86400000000"}

NOW = "TIMESTAMP '2024-01-20 09:00:00'"
TODAY = "DATE '2024-01-20'"
MONTH_START = "DATE '2024-01-01'"
CLOCK_US = "32400000000"
HOUR_US = "3600000000"

_CLOCK = {
    "$now": NOW, "$today": TODAY, "$month": MONTH_START, "$clock": CLOCK_US, "$hour": HOUR_US,
}


def _plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", render(text, DIALECT)).strip()


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None


def sql(query: str, delivered: bool = False) -> str:
    """Prefix a query on the club's tables with the CTEs it needs.

    Mapped tables are called g_<table>, requests r_<name>, deliveries d_<table>. In the
    query, $now, $today, $month, $clock and $hour stand for the test clock.
    """
    for mark, literal in _CLOCK.items():
        query = query.replace(mark, literal)
    ctes: dict[str, str] = {}

    def need(text: str) -> None:
        for prefix, source in (("g_", MAPPING), ("r_", REQUESTS), ("d_", DELIVERIES)):
            for name, body in source.items():
                cte = prefix + name
                if cte in ctes or not _mentions(text, cte):
                    continue
                body = render(body, DIALECT)
                # within deliveries, {table} means the mapped table of that name
                if prefix == "d_":
                    body = re.sub(
                        r"\{(\w+)\}", lambda m: ("g_" if m[1] in MAPPING else "") + m[1], body
                    )
                    need(body)
                ctes[cte] = _plain(body)

    need(query)
    if not ctes:
        return query.strip()
    head = ",\n".join(f"{name} AS ({body})" for name, body in ctes.items())
    return f"WITH {head}\n{query.strip()}"
