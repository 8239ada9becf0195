"""Tables in the folder that driver and executors share, and running totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(docs: DataFrame) -> DataFrame:
    """The same frame, whose session from now on sends texts to Python in Arrow batches of a few MB, unless a size is set already: 64 MB a batch and task, held twice, would take much of an executor."""
    if docs.sparkSession.conf.get(BATCH, None) is None:
        docs.sparkSession.conf.set(BATCH, "4m")
    return docs


def folder(spark: SparkSession) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``. Where that is unset, a temporary one, but only on a local master: other machines couldn't read it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="codexweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The rows written to the shared folder and read again: later failures go back no further than this table."""
    path = folder(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidied(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``cut``, whose shuffle files go as soon as the table is written: else they stay until the driver happens to collect its garbage."""
    name, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession.conf
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return cut(df, compression)
    finally:
        conf.set(name, before)


def drop(df: DataFrame) -> None:
    """Delete a table made by ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def before(df: DataFrame, by: str, value: str, name: str, block: int = 1024) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows with a smaller ``by`` (distinct integers from 0), in two levels."""
    inner = Window.partitionBy("_block").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_block", F.floor(F.col(by) / block))
    totals = df.groupBy("_block").agg(F.sum(value).alias("_total")).withColumn("_base", F.coalesce(F.sum("_total").over(outer), F.lit(0)))
    inside = F.coalesce(F.sum(value).over(inner), F.lit(0))
    return df.withColumn("_inside", inside).join(totals.drop("_total"), "_block").withColumn(name, F.col("_inside") + F.col("_base")).drop("_inside", "_base", "_block")


def small(df: DataFrame, limit_mb: float = 4) -> DataFrame:
    """A table made by ``cut``, or one cut here, marked for broadcast if its compressed files are within the limit (some ten times that when decoded); else left to a shuffled join."""
    spark = df.sparkSession
    if not df.inputFiles():
        return df
    total = 0
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        total += target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(target).getLength()
    return F.broadcast(df) if total <= limit_mb * 1e6 else df


def sifted(rows: DataFrame, key: str, wanted: DataFrame, words: int = 1 << 18) -> DataFrame:
    """Rows whose ``key``, a 64-bit hash, may be among those of ``wanted``: an exact join has to follow.

    A bitmap of 64 * ``words`` bits, as that many rows at most whatever the input, goes to all tasks, so texts that nobody asks for are not shuffled.
    """
    word, bit = F.pmod(F.shiftright(key, 6), F.lit(words)), F.col(key).bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bitmap = wanted.groupBy(word.alias("_word")).agg(F.bit_or(one).alias("_bits"))
    met = rows.withColumn("_word", word).join(F.broadcast(bitmap), "_word")
    return met.filter(F.col("_bits").bitwiseAND(one) != 0).select(*rows.columns)
