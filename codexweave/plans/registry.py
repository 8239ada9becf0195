"""All queries over the standard tables, by importing the modules that register them."""

from __future__ import annotations

from . import catalogue, changes, editions, reading, structure, works  # noqa: F401
from .tables import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
