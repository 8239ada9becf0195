"""Writes as functions from a table and its changes to the new table: Parquet has no MERGE, so a caller overwrites with the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING: rows of new keys are added, one of each key."""
    fresh = rows.join(table.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return table.unionByName(fresh.select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """ON CONFLICT DO UPDATE: the last row of each key replaces or adds; applying the same rows again changes nothing."""
    newest = latest(rows, keys, order)
    return table.join(newest.select(*keys), keys, "left_anti").unionByName(newest.select(*table.columns))


def patch(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Patches in three states: a column ``set_x`` that isn't true leaves x as it is, otherwise x is taken, null included."""
    named = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], *[F.col(f"set_{c}") for c in columns])
    joined = table.join(named, keys, "left")
    return joined.select(*[F.when(F.col(f"set_{c}"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def patch_present(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Patches by COALESCE: null leaves a column as it is."""
    joined = table.join(changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns]), keys, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def delete(table: DataFrame, keys_gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(keys_gone.select(*keys), keys, "left_anti")


def delete_unreferenced(table: DataFrame, wanted: DataFrame, keys: list[str], references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without the wanted rows that nothing refers to, and the wanted keys that were refused."""
    refused = wanted.join(references.select(*keys), keys, "left_semi").select(*keys).distinct()
    return delete(table, wanted.join(refused, keys, "left_anti"), keys), refused


def transition(table: DataFrame, wanted: DataFrame, keys: list[str], status: str, allowed: str, target: str) -> DataFrame:
    """Rows in ``wanted`` go from status ``allowed`` to ``target``; all others stay."""
    joined = table.join(wanted.select(*keys).distinct().withColumn("_w", F.lit(True)), keys, "left")
    moved = F.when(F.col("_w") & (F.col(status) == allowed), F.lit(target)).otherwise(F.col(status))
    return joined.withColumn(status, moved).drop("_w").select(*table.columns)


def replace_set(table: DataFrame, owners: DataFrame, rows: DataFrame, owner: list[str]) -> DataFrame:
    """All rows of the owners are replaced by the distinct given ones."""
    return delete(table, owners, owner).unionByName(rows.join(owners.select(*owner).distinct(), owner, "left_semi").select(*table.columns).distinct())


def prepend(table: DataFrame, rows: DataFrame, group: str, position: str) -> DataFrame:
    """New members come first, in the order of their positions; the others move up."""
    fresh = rows.withColumn("_new", F.lit(0)).unionByName(table.withColumn("_new", F.lit(1)))
    return fresh.withColumn(position, F.row_number().over(Window.partitionBy(group).orderBy("_new", position)).cast("long")).drop("_new")


def remove_dense(table: DataFrame, gone: DataFrame, group: str, member: str, position: str) -> DataFrame:
    """Members go, the positions of the rest close up."""
    left = delete(table, gone, [group, member])
    return left.withColumn(position, F.row_number().over(Window.partitionBy(group).orderBy(position)).cast("long"))


def expire(table: DataFrame, at: str, now: Column, seconds: int, parents: DataFrame, key: str) -> DataFrame:
    """Rows older than a time to live go, and those whose parent is gone."""
    alive = table.filter(F.unix_micros(F.col(at).cast("timestamp")) >= F.unix_micros(now) - seconds * 1_000_000)
    return alive.join(parents.select(key), key, "left_semi")
