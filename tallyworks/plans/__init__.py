"""Registered queries: operators applied to the given tables, with equivalent SQL."""

from . import catering, charts, company, delivery, estate, experiment, games, preparation, quality, talks, tickets

MODULES = (
    company, preparation, estate, tickets, games, talks, catering, delivery, experiment, quality, charts,
)


def all_queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
