"""Independent DuckDB versions of the registered queries."""


def oracle_queries() -> dict[str, str]:
    from oracle import figures, jobs, rules, views

    return {**views.ORACLE, **jobs.ORACLE, **rules.ORACLE, **figures.ORACLE}
