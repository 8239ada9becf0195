"""Resources of a book at requested places: its own, and those of other editions projected through canonical passages, in one order.

Requests are rows, so that any number of them is answered by the same joins. Places meet by overlap joins over bins; a passage of several
sentences, or a sentence of several passages, projects to the span from the first to the last that it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import overlap_join

SPAN = 64


def _shown(resources: DataFrame) -> DataFrame:
    return resources.filter("archived_at IS NULL")


def native(requests: DataFrame, resources: DataFrame) -> DataFrame:
    """request, resource, first, last: a book's own resources that touch the requested sentences, approved or the viewer's own pending ones.

    ``requests``: request, book, kind, start, stop, viewer; ``resources``: resource, book, kind, start, stop (null: one sentence), status, submitted_by, archived_at.
    """
    spans = _shown(resources).select("resource", "book", "kind", F.col("start").alias("first"), F.coalesce("stop", "start").alias("last"), "status", "submitted_by")
    met = overlap_join(requests, spans, ["book", "kind"], ("start", "stop"), ("first", "last"), SPAN)
    own = (F.col("status") == "pending") & (F.col("submitted_by") == F.col("viewer"))
    return met.filter((F.col("status") == "approved") | F.coalesce(own, F.lit(False))).select("request", "resource", "first", "last", F.lit(None).cast("string").alias("origin"))


def projected(requests: DataFrame, resources: DataFrame, sentences: DataFrame) -> DataFrame:
    """request, resource, first, last, origin (its book): approved resources of other editions of the work whose passages touch the requested ones.

    ``sentences``: book, kind, number, work, ordinal (of its passage); those without a passage project nothing and receive nothing.
    """
    known = sentences.filter("ordinal IS NOT NULL")
    places = known.select("book", "kind", F.col("number").alias("n_first"), F.col("number").alias("n_last"), "work", "ordinal")
    wanted = overlap_join(requests, places, ["book", "kind"], ("start", "stop"), ("n_first", "n_last"), SPAN)
    targets = wanted.groupBy("request", F.col("book").alias("target"), "kind", "work").agg(F.min("ordinal").alias("low"), F.max("ordinal").alias("high"))
    spans = _shown(resources).filter("status = 'approved'").select("resource", "book", "kind", "start", F.coalesce("stop", "start").alias("stop"), F.col("stop").isNotNull().alias("long"))
    at = known.select("book", "kind", "number", "work", "ordinal")
    begin = spans.join(at.select("book", "kind", F.col("number").alias("start"), "work", F.col("ordinal").alias("o_first")), ["book", "kind", "start"])
    ended = begin.join(at.select("book", "kind", F.col("number").alias("stop"), F.col("ordinal").alias("o_last")), ["book", "kind", "stop"], "left")
    peers = ended.select("resource", F.col("book").alias("origin"), "kind", "work", "o_first", F.when(F.col("long"), F.coalesce("o_last", "o_first")).otherwise(F.col("o_first")).alias("o_last"))
    forward = peers.filter("o_first <= o_last")
    met = overlap_join(targets, forward, ["work", "kind"], ("low", "high"), ("o_first", "o_last"), SPAN).filter("origin <> target")
    # Where a peer's passages lie in the requested book.
    pairs = met.select("target", "kind", "work", "o_first", "o_last").distinct()
    homes = known.select(F.col("book").alias("target"), "kind", "work", "number", F.col("ordinal").alias("p_first"), F.col("ordinal").alias("p_last"))
    landed = overlap_join(pairs, homes, ["target", "kind", "work"], ("o_first", "o_last"), ("p_first", "p_last"), SPAN)
    spots = landed.groupBy("target", "kind", "work", "o_first", "o_last").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    out = met.join(spots, ["target", "kind", "work", "o_first", "o_last"], "left")
    return out.select("request", "resource", "first", "last", F.col("origin").cast("string").alias("origin"))


def listed(requests: DataFrame, resources: DataFrame, sentences: DataFrame, about: DataFrame) -> DataFrame:
    """Both with ``place``, their order in each request: featured first, then the newest year, the first page and the resource. ``about``: resource, featured, year, page."""
    both = native(requests, resources).unionByName(projected(requests, resources, sentences)).join(about, "resource")
    order = [F.desc("featured"), F.desc_nulls_last("year"), F.asc_nulls_last("page"), F.asc("resource")]
    return both.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(*order)) - 1)
