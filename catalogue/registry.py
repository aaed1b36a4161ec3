"""All registered queries and the SQL they are checked against."""

from catalogue import cohort, evaluation, explain, features, modelling, profile, sampling, sources

SECTIONS = [sources, cohort, features, profile, sampling, modelling, evaluation, explain]


def all_queries() -> dict:
    return {name: q for s in SECTIONS for name, q in s.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for s in SECTIONS for name, sql in s.ORACLES.items()}
