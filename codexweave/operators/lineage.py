"""Tables written between steps, so that later steps and failures go back no further."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a temporary folder on a local master; elsewhere it must be set, since other machines could not read one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="codexweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(df: DataFrame) -> DataFrame:
    """The same frame, whose session from now on sends texts to Python in Arrow batches of 4 MB, unless a size is set already: what a Python task holds then doesn't grow with the texts."""
    if df.sparkSession.conf.get(BATCH, None) is None:
        df.sparkSession.conf.set(BATCH, "4m")
    return df


DEALT = "spark.sql.requireAllClusterKeysForCoPartition"


def dealt(df: DataFrame, *keys: str, finer: int | None = None) -> DataFrame:
    """The rows shuffled by ``keys``, once: groups, windows and, in this session from now on, joins by these keys and further ones need no other shuffle.

    ``finer``, for a plain scan: so many partitions for each of its own, as one task then holds all that is made of its rows.
    """
    df.sparkSession.conf.set(DEALT, "false")
    return df.repartition(finer * max(df.rdd.getNumPartitions(), 1), *keys) if finer else df.repartition(*keys)
