"""Interval, as-of and projection joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of equal keys whose closed integer spans overlap.

    Both sides are dealt over bins of ``width``; a pair counts in the first bin that both have, so it comes once. Width should be
    near the usual span: wider bins compare more pairs, narrower ones copy more rows.
    """

    def binned(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        low, high = (F.floor(F.col(c) / width) for c in span)
        return df.withColumn(name, low).withColumn("_bin", F.explode(F.sequence(low, high)))

    a, b = binned(left, left_span, "_la"), binned(right, right_span, "_lb")
    met = a.join(b, [*keys, "_bin"])
    inside = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(left_span[1]) >= F.col(right_span[0]))
    return met.filter(inside & (F.col("_bin") == F.greatest("_la", "_lb"))).drop("_bin", "_la", "_lb")


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """For each left row the value of the last right row at or before it: a union and one window, no join."""
    a = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*keys, *order, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    window = Window.partitionBy(*keys).orderBy(*order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(name, F.last("_v", ignorenulls=True).over(window)).filter("_side = 1").drop("_side", "_v")


def three_state(df: DataFrame, mapping: DataFrame, keys: list[str], local: str, canonical: str, name: str) -> DataFrame:
    """Local references in canonical terms: no row in ``mapping`` is identity, a row with null has no target."""
    there = mapping.select(*keys, F.col(local), F.col(canonical).alias("_c"), F.lit(True).alias("_mapped"))
    joined = df.join(there, [*keys, local], "left")
    return joined.withColumn(name, F.when(F.col("_mapped").isNull(), F.col(local)).otherwise(F.col("_c"))).drop("_c", "_mapped")


def shift_alignment(counts: DataFrame, unit: str, local: str, canonical: str) -> DataFrame:
    """Alignment rows for units that begin with extra verses: the first ``local - canonical`` have no target, the rest are shifted."""
    shifted = counts.filter(F.col(local) > F.col(canonical)).withColumn("_shift", F.col(local) - F.col(canonical))
    verses = shifted.withColumn("local_ref", F.explode(F.sequence(F.lit(1).cast("long"), F.col(local).cast("long"))))
    target = F.when(F.col("local_ref") > F.col("_shift"), F.col("local_ref") - F.col("_shift"))
    return verses.select(unit, "local_ref", target.cast("long").alias("canonical_ref"))


def span(df: DataFrame, keys: list[str], ordinal: Column) -> DataFrame:
    """First and last ordinal of each anchor."""
    return df.groupBy(*keys).agg(F.min(ordinal).alias("low"), F.max(ordinal).alias("high"))
