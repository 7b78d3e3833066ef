"""Registered queries of the reference's operators, and their SQL."""

from stimfuse.plans import averages, correlation, inference, joins, models, pipelines, projections, sources

MODULES = [averages, projections, correlation, inference, joins, models, sources, pipelines]


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: q for m in MODULES for k, q in m.SQL.items()}
