"""Streams of events: dedup gates, upserts, trailing windows, rate limits and incremental refresh."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.mutations import upsert
from ..operators.versions import Files, Versions


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a folder as they arrive, ts as an instant."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, key: str = "event_id", delay: str = "1 day") -> DataFrame:
    """Each event once within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def trailing(events: DataFrame, key: str, delay: str = "1 hour", length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Counts per key over sliding windows."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length, slide), key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def _done(table: Versions, number: int) -> bool:
    last = table.latest()
    return last is not None and table.manifest(last)["batch"] >= number


def upserting(path: str, keys: list[str], order: list[Column], empty_schema, keep: int = 2):
    """A foreachBatch function that keeps the newest row of each key in a versioned table (``Versions``) under ``path``, a version per batch.

    A repeated batch finds its number in the manifest and does nothing; versions but the last ``keep`` are deleted.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions = Versions(spark, path)
        if _done(versions, number):
            return
        table = versions.read()
        table = spark.createDataFrame([], empty_schema) if table is None else table
        versions.commit(upsert(table, batch.select(*table.columns), keys, order), batch=number)
        versions.clean(keep)

    return apply


def refreshing(path: str, key: str, content: str, changed, keep: int = 2) -> object:
    """A foreachBatch function for snapshots: only keys whose content hash differs from the last ones go to ``changed(rows, number)``.

    The hashes are a versioned table; ``changed`` runs before its commit, so a batch that fails in between is given again with the same number.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions = Versions(spark, path)
        if _done(versions, number):
            return
        new = batch.withColumn("_hash", F.sha2(content, 256))
        last = versions.read()
        last = spark.createDataFrame([], new.select(key, "_hash").schema) if last is None else last
        fresh = new.join(last, [key, "_hash"], "left_anti")
        changed(fresh.drop("_hash"), number)
        versions.commit(last.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(key, "_hash")), batch=number)
        versions.clean(keep)

    return apply


def new_artefacts(spark: SparkSession, path: str, state: str, build, checkpoint: str, pattern: str = "*.json"):
    """Start a run over the files that have come under ``path``: ``build(files, number)`` gets path, content and hash of those whose content no earlier run had, and the run ends.

    The hashes of all contents ever built are a table under ``state``, a folder a batch: new ones are found by an anti join, and a
    repeated batch writes its own folder again, which it leaves out when it looks. Equal files of one batch are built once.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)

    def apply(batch: DataFrame, number: int) -> None:
        known = Files(spark, state)
        earlier = [f"{known.root}/{n}" for n in known.names("") if n.startswith("batch=") and n != f"batch={number}"]
        hashed = batch.select("path", "content", F.sha2("content", 256).alias("hash"))
        fresh = hashed.groupBy("hash").agg(F.min_by("path", "path").alias("path"), F.min_by("content", "path").alias("content"))
        if earlier:
            fresh = fresh.join(spark.read.schema("hash string").parquet(*earlier), "hash", "left_anti")
        if not fresh.isEmpty():
            build(fresh, number)
        fresh.select("hash").write.mode("overwrite").parquet(f"{known.root}/batch={number}")

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limited(events: DataFrame, key: str, capacity: float, per_second: float, delay: str = "1 hour") -> DataFrame:
    """key, ts, allowed: a token bucket per key, its level kept as state and dropped after it must be full again."""
    idle = int(capacity / per_second * 1000) + 1

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        level, last = state.get if state.exists else (capacity, rows["ts"].iloc[0].timestamp())
        allowed = []
        for ts in rows["ts"]:
            now = max(ts.timestamp(), last)
            level, last = min(capacity, level + (now - last) * per_second), now
            allowed.append(level >= 1)
            level -= allowed[-1]
        state.update((level, last))
        state.setTimeoutTimestamp(max(int(last * 1000) + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: group[0], "ts": rows["ts"].to_numpy(), "allowed": allowed})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "ts").withWatermark("ts", delay).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts timestamp, allowed boolean", "level double, last double", "append", GroupStateTimeout.EventTimeTimeout)
