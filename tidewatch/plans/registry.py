"""All registered queries and their SQL twins."""

from __future__ import annotations

from tidewatch.plans import alerts, drift, features, ingest, models, operations, rules, streams

_FAMILIES = (features, rules, drift, alerts, ingest, models, streams, operations)


def queries():
    return {name: fn for family in _FAMILIES for name, fn in family.QUERIES.items()}


def oracles():
    return {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
