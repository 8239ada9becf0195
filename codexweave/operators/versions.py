"""Tables in versions: each commit writes new files and then one small manifest, which alone makes them visible.

A manifest is created under its number only if nobody has: of two writers one fails and can read again. Readers go by the highest
manifest, so they never see half a write; a run that dies leaves files that no manifest names, which ``clean`` deletes. Snapshots are manifests of
several tables with their row counts and order-free digests, checked when they are restored. Rows are written and read by tasks; the driver
handles manifests only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Files:
    """A folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> None:
        """Write a new file; fails if it is there. The file shows under its name only when it is whole."""
        target, draft = self.path(name), self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        if self.fs.exists(target) or not self.fs.rename(draft, target):
            self.fs.delete(draft, False)
            raise Conflict(name)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Row count and a digest that does not depend on the rows' order: a sum and an exclusive or of row hashes."""
    row = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    found = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
    return found["n"], f"{found['s']}:{found['x']}"


class Versions:
    """One table: ``commit`` adds a version, ``read`` gives one, ``clean`` drops old ones."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names("manifests") if n.endswith(".json"))

    def latest(self) -> int | None:
        return max(self.numbers(), default=None)

    def manifest(self, number: int) -> dict:
        return self.files.read(f"manifests/{number:012d}.json")

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version, the latest by default; None if there is none."""
        number = self.latest() if number is None else number
        if number is None:
            return None
        entry = self.manifest(number)
        return self.spark.read.schema(entry["schema"]).parquet(f"{self.files.root}/{entry['data']}")

    def commit(self, rows: DataFrame, after: int | None = None, **about) -> int:
        """Write the rows as the version behind ``after`` (the latest by default); raises ``Conflict`` if that one is taken."""
        after = self.latest() if after is None else after
        number, data = 0 if after is None else after + 1, f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.files.root}/{data}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        try:
            self.files.create(f"manifests/{number:012d}.json", {"data": data, "schema": schema} | about)
        except Conflict:
            self.files.delete(data)
            raise
        return number

    def clean(self, keep: int = 2) -> int:
        """Delete all versions but the last ``keep`` and every file that none of those names; the number of folders deleted. Not while others write."""
        kept = self.numbers()[-keep:]
        named = {self.manifest(n)["data"].rpartition("/")[2] for n in kept}
        for n in self.numbers():
            if n not in kept:
                self.files.delete(f"manifests/{n:012d}.json")
        gone = [n for n in self.files.names("data") if n not in named]
        for n in gone:
            self.files.delete(f"data/{n}")
        return len(gone)


def dump(spark: SparkSession, root: str, name: str, tables: dict[str, DataFrame], keep: int = 60) -> None:
    """A snapshot of several tables under a name that sorts by time; the oldest beyond ``keep`` go. Visible only when all tables are written."""
    files, entry, folder = Files(spark, root), {}, f"data/{name}-{uuid.uuid4().hex}"
    for table, df in tables.items():
        data = f"{folder}/{table}"
        df.write.parquet(f"{files.root}/{data}")
        n, digest = fingerprint(spark.read.schema(df.schema).parquet(f"{files.root}/{data}"))
        entry[table] = {"data": data, "rows": n, "digest": digest, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)}
    try:
        files.create(f"snapshots/{name}.json", entry)
    except Conflict:
        files.delete(folder)
        raise
    for old in [x for x in files.names("snapshots") if x.endswith(".json")][:-keep]:
        for x in files.read(f"snapshots/{old}").values():
            files.delete(x["data"].rpartition("/")[0])
        files.delete(f"snapshots/{old}")


def restore(spark: SparkSession, root: str, name: str | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, the last by default; raises if a table is not what was written."""
    files = Files(spark, root)
    name = name or [x for x in files.names("snapshots") if x.endswith(".json")][-1].removesuffix(".json")
    out = {}
    for table, x in files.read(f"snapshots/{name}.json").items():
        df = spark.read.schema(x["schema"]).parquet(f"{files.root}/{x['data']}")
        try:
            same = fingerprint(df) == (x["rows"], x["digest"])
        except PySparkException as error:
            raise RuntimeError(f"snapshot {name}: {table} cannot be read") from error
        if not same:
            raise RuntimeError(f"snapshot {name}: {table} differs from what was written")
        out[table] = df
    return out

