"""All named queries."""

from __future__ import annotations

from paneltide.plans import cells, columns, features, joins, profiles, reads, streams  # noqa: F401
from paneltide.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
