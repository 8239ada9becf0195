"""Names and places of a corpus's files by rules that each corpus brings: a slug rule and a position rule, both column expressions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that the file names of German editions spell out.
GERMAN = {"ä": "ae", "Ä": "ae", "ö": "oe", "Ö": "oe", "ü": "ue", "Ü": "ue", "ß": "ss"}
LONG_S = {"ſ": "s"}
AMPERSAND = {"&": " and"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def file_slug(spelled: dict[str, str]) -> Callable[[Column], Column]:
    """A slug rule: ``spelled`` replaced, A-Z in lower case, all but a-z and 0-9 as single underscores, none at the ends."""

    def slug(label: Column) -> Column:
        for a, b in spelled.items():
            label = F.replace(label, F.lit(a), F.lit(b))
        return F.regexp_replace(F.regexp_replace(F.translate(label, _UPPER, _LOWER), "[^a-z0-9]+", "_"), "^_|_$", "")

    return slug


def places_without(removed: list[int]) -> Callable[[Column], Column]:
    """A position rule: files counted from 1, passing over the places of removed files."""

    def place(index: Column) -> Column:
        return F.aggregate(F.array(*map(F.lit, sorted(removed))).cast("array<bigint>"), index.cast("long") + 1, lambda at, gone: at + (at >= gone).cast("long"))

    return place


class Rules(NamedTuple):
    slug: Callable[[Column], Column]
    place: Callable[[Column], Column]


def named(files: DataFrame, rules: dict[str, Rules]) -> DataFrame:
    """Add sort_order, source_ref (three digits at least), slug (hyphens) and filename to rows with corpus, file_index and label.

    A null label has a null slug and file name; a null index no place; a corpus without rules fails.
    """

    def chosen(part: Callable[[Rules], Column]) -> Column:
        branches = [(F.col("corpus") == name, part(r)) for name, r in rules.items()]
        out = F.raise_error(F.concat(F.lit("no rules for corpus "), F.coalesce("corpus", F.lit("null"))))
        for known, value in reversed(branches):
            out = F.when(known, value).otherwise(out)
        return out

    told = files.withColumn("sort_order", chosen(lambda r: r.place(F.col("file_index")))).withColumn("_slug", chosen(lambda r: r.slug(F.col("label"))))
    digits = F.col("sort_order").cast("string")
    ref = F.lpad(digits, F.greatest(F.char_length(digits), F.lit(3)), F.lit("0"))
    return told.withColumn("source_ref", ref).withColumn("slug", F.replace("_slug", F.lit("_"), F.lit("-"))).withColumn("filename", F.concat("source_ref", F.lit("_"), "_slug", F.lit(".md"))).drop("_slug")
