"""All registered queries outside the optional subpackages, each with its SQL where SQL can express it."""

from __future__ import annotations

from lattix.plans import balancing, iterative, keyed, learning, matrices, queueing, streams  # noqa: F401
from lattix.plans.registry import QUERIES, Query


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
