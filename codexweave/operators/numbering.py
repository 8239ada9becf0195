"""Numbers in document order, islands, content changes and containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import staged


def renumber(df: DataFrame, keys: list[str], order: list[str], name: str, start: int = 1) -> DataFrame:
    """Dense numbers per book in full document order; ``order`` must tell rows apart.

    Rows are dealt by ranges of the order and numbered in each, behind the counts of a book's earlier ranges, so a book may be larger than a task.
    """
    dealt = staged(df.repartitionByRange(*keys, *order).withColumn("_r", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(*keys, "_r").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    bases = bases.filter("_base > 0").select("_r", "_base", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    inside = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(*order))).alias("x")
    same = F.col("x._r") == F.col("b._r")
    for i, k in enumerate(keys):
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"b._k{i}"))
    number = (F.col(f"x.{name}") + F.coalesce("b._base", F.lit(0)) + (start - 1)).cast("long")
    return inside.join(bases.alias("b"), same, "left").select(*[F.col(f"x.{c}") for c in df.columns if c != name], number.alias(name))


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str) -> DataFrame:
    """Runs between breaking rows, numbered by how many of these came before; the breaking rows themselves go."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_b", breaks).withColumn(name, F.sum(F.col("_b").cast("long")).over(window)).filter(~F.col("_b")).drop("_b")


def gap_groups(df: DataFrame, keys: list[str], at: Column, order: list[str], factor: float, name: str) -> DataFrame:
    """Groups that begin where the gap to the previous row is more than ``factor`` times the key's median gap."""
    window = Window.partitionBy(*keys).orderBy(*order)
    gaps = df.withColumn("_at", at).withColumn("_gap", F.col("_at") - F.lag("_at").over(window))
    middle = gaps.groupBy(*keys).agg(F.median("_gap").alias("_mid"))
    wide = F.coalesce((F.col("_gap") > factor * F.col("_mid")).cast("long"), F.lit(0))
    return gaps.join(middle, keys).withColumn(name, F.sum(wide).over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_at", "_gap", "_mid")


def changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Keys that were added, removed or changed between two layers of (key, hash)."""
    a, b = old.select(key, F.col(content).alias("_a")), new.select(key, F.col(content).alias("_b"))
    joined = a.join(b, key, "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return joined.select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed").alias("change"))


def contained(texts: DataFrame, quotes: DataFrame, form: str, quote: str, key: str, words: int = 8) -> DataFrame:
    """Pairs where the padded word form of a text holds that of a quote.

    Quotes are found by the hashes of their first ``words`` words (all of a shorter one's) among the texts' word runs of that
    length: only ``key`` and hashes are exploded, and the texts of the candidates alone are tested in full.
    """
    split = F.split(F.trim(F.col(quote)), " ")
    size = F.least(F.size(split), F.lit(words))
    keyed = quotes.filter(F.trim(F.col(quote)) != "").withColumn("_n", size).withColumn("_k", F.xxhash64(F.transform(F.slice(split, F.lit(1), size), lambda w: F.xxhash64(w))))
    sizes = [r["_n"] for r in keyed.select("_n").distinct().collect()]
    hashed = texts.withColumn("_h", F.transform(F.split(F.trim(F.col(form)), " "), lambda w: F.xxhash64(w)))
    none = F.array().cast("array<bigint>")

    def runs(n: int) -> Column:
        places = F.sequence(F.lit(1), F.size("_h") - (n - 1))
        return F.when(F.size("_h") >= n, F.transform(places, lambda i: F.xxhash64(F.slice("_h", i, F.lit(n))))).otherwise(none)

    spread = hashed.withColumn("_k", F.explode(F.array_distinct(F.concat(none, *[runs(n) for n in sizes])))).select(key, "_k")
    met = spread.join(keyed, "_k").drop("_k", "_n").distinct()
    return met.join(texts, key).filter(F.contains(form, F.col(quote)))
