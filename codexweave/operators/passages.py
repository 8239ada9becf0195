"""Canonical passages: minted from a leading edition, stamped onto the sentences of all editions, and kept in articles' references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["work", "source_ref", "ref_value"]


def minted(passages: DataFrame, verses: DataFrame) -> DataFrame:
    """work, source_ref, ref_value, ordinal: the leading edition's verses (with ``number``, a row a sentence) numbered in order through each work; known passages get the new
    ordinal, those that it lacks stay as they are."""
    firsts = verses.groupBy(*KEYS).agg(F.min("number").alias("_first"))
    order = Window.partitionBy("work").orderBy("_first", "source_ref", "ref_value")
    fresh = firsts.select(*KEYS, F.row_number().over(order).cast("long").alias("_new"))
    both = passages.join(fresh, KEYS, "full")
    return both.select(*KEYS, F.coalesce("_new", "ordinal").alias("ordinal"))


def stamped(sentences: DataFrame, alignments: DataFrame, passages: DataFrame) -> DataFrame:
    """sentence, ordinal (of its passage, null without one) of those sentences whose stamp changes.

    ``sentences``: sentence, book, work, source_ref, ref_value, ordinal (the stamp so far); ``alignments``: book, source_ref, ref_value, canonical_source_ref,
    canonical_ref_value, both null for a verse that has no canonical one. Without an alignment a verse's own place is canonical.
    """
    local = alignments.withColumn("_aligned", F.lit(True))
    met = sentences.join(local, ["book", "source_ref", "ref_value"], "left")
    ref, value = (F.when(F.col("_aligned").isNull(), F.col(own)).otherwise(F.col(f"canonical_{own}")) for own in ("source_ref", "ref_value"))
    placed = met.select("sentence", "work", ref.alias("source_ref"), value.alias("ref_value"), F.col("ordinal").alias("_old"))
    found = placed.join(passages, KEYS, "left")
    return found.filter(~F.col("_old").eqNullSafe(F.col("ordinal"))).select("sentence", "ordinal")


def resynced(references: DataFrame, articles: DataFrame, directives: DataFrame, books: DataFrame, sentences: DataFrame) -> DataFrame:
    """article, book, kind, start, stop (sentence ids): the saved ``articles`` lose their references and get those that their directives resolve to; others keep theirs.

    ``directives``: article, slug, kind, first, last (null: one sentence), as the articles have them now; ``sentences``: sentence, book, kind, number. A directive whose
    book, first or given last sentence is unknown gives none; equal ones give one.
    """
    known = sentences.select("book", "kind", "number", "sentence")
    wanted = directives.join(articles.select("article").distinct(), "article", "left_semi").join(books.select("slug", "book"), "slug")
    begin = wanted.join(known.select("book", "kind", F.col("number").alias("first"), F.col("sentence").alias("start")), ["book", "kind", "first"])
    ended = begin.join(known.select("book", "kind", F.col("number").alias("last"), F.col("sentence").alias("stop")), ["book", "kind", "last"], "left")
    fresh = ended.filter(F.col("last").isNull() | F.col("stop").isNotNull()).select("article", "book", "kind", "start", "stop").distinct()
    return references.join(articles.select("article").distinct(), "article", "left_anti").select(*fresh.columns).unionByName(fresh)
