"""Joins, aggregates, pages and set operations that the catalogue queries are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_list(left: DataFrame, right: DataFrame, on: Column, keys: list[str], value: Column, order: list[Column], name: str) -> DataFrame:
    """Per left row the right rows' values in order, joined by ', '; null where there are none.

    Aggregated before the join, so that only one row per key meets the left side.
    """
    item = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], value.cast("string").alias("v"))
    lists = right.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]), ", ").alias(name))
    return left.join(lists, on, "left")


def counts_kept(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str) -> DataFrame:
    """How many right rows each left row has; zero where there are none."""
    counted = right.groupBy(F.col(right_key).alias("_k")).agg(F.count("*").alias(name))
    return left.join(counted, F.col(left_key) == F.col("_k"), "left").withColumn(name, F.coalesce(name, F.lit(0))).drop("_k")


def flagged(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str) -> DataFrame:
    """EXISTS as a column: whether ``right`` has a row of the same key."""
    there = right.select(F.col(right_key).alias("_k")).distinct()
    return left.join(there, F.col(left_key) == F.col("_k"), "left").withColumn(name, F.col("_k").isNotNull()).drop("_k")


def any_of(df: DataFrame, key: str, branches: list[DataFrame]) -> DataFrame:
    """Rows whose key is in one of the branches: one semi-join against their union, instead of an OR of EXISTS."""
    return df.join(reduce(DataFrame.union, branches).toDF(key).distinct(), key, "left_semi")


def with_total(df: DataFrame, order: list[Column], offset: int, limit: int, name: str = "total") -> DataFrame:
    """One page, each row with the number of all rows. The total is one row, joined to a page of bounded size."""
    total = df.agg(F.count("*").alias(name))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), F.lit(True))


def keyset_page(df: DataFrame, key: str, after: int | None, limit: int, backward: bool = False) -> DataFrame:
    """A page of ``limit`` rows beyond a key, in key order, with has_more from one row more than asked for."""
    found = df if after is None else df.filter(F.col(key) < after if backward else F.col(key) > after)
    probe = found.orderBy(F.col(key).desc() if backward else F.col(key).asc()).limit(limit + 1)
    way = Window.orderBy(F.col(key).desc() if backward else F.col(key).asc())
    numbered = probe.withColumn("_n", F.row_number().over(way)).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit)
    return numbered.filter(F.col("_n") <= limit).drop("_n")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: idempotent application of a log of changes."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)


def majority(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value per key; of ties the greatest. Counted by (key, value) first, so hot keys are combined early."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.max(F.struct("_n", value)).alias("_m")).select(*keys, F.col(f"_m.{value}").alias(name), F.col("_m._n").alias("votes"))


def both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity: side, columns."""
    return left.exceptAll(right).select(F.lit("left").alias("side"), "*").unionByName(right.exceptAll(left).select(F.lit("right").alias("side"), "*"))


def parity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose numbers of rows differ between two layers: keys, n_left, n_right."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("n_left")), right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    joined = a.join(b, keys, "full").na.fill(0, ["n_left", "n_right"])
    return joined.filter("n_left <> n_right")


def trailing_counts(df: DataFrame, key: str, ts: str, seconds: int, name: str) -> DataFrame:
    """How many rows of the key lie in the interval of ``seconds`` that ends with each row."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    window = Window.partitionBy(key).orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("_us", micros).withColumn(name, F.count("*").over(window)).drop("_us")


def fingerprint(df: DataFrame, ts: str) -> DataFrame:
    """One row that changes when the table does: number of rows and latest change."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.max(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("latest"))
