"""Canonical encodings and digests of nested content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def field(value: Column) -> Column:
    return F.concat(value.cast("string"), F.lit(SEPARATOR))


def optional(value: Column) -> Column:
    """Null and '' differ: N, or S before the field."""
    return F.when(value.isNull(), F.lit("N" + SEPARATOR)).otherwise(F.concat(F.lit("S"), field(value)))


def listed(items: Column) -> Column:
    """An array of encoded strings behind its length, so that moving a border between two lists shows."""
    return F.concat(field(F.size(items)), F.array_join(items, ""))


def digest(encoded: Column) -> Column:
    return F.sha2(encoded, 256)
