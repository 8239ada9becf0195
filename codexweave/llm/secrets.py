"""Secret scans (6, native): base patterns, and multipart credentials linked by an interval join.

Base spans are the leftmost non-overlapping matches of three patterns. Weak candidates (client
identifiers, bare 40-character keys, endpoints) mean little alone: one is reported only if complementary
parts lie within ``SCOPE`` code points of it: an identifier needs a secret, a key needs an identifier, an
endpoint needs both. Parts meet by an equi-join on (document, bin of the scope) with the range as its condition,
as semi-joins, so nothing is multiplied.

Positions are code points, ends exclusive. A null text is an empty one; repeated rows each give their own result;
a null doc_id is kept; an empty table gives no rows; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

SCOPE = 400
BLOCK = 256

#: Kind, role, pattern, group whose length counts, its least length. The first three are the base.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [
    ("assign", "secret", ASSIGN, 2, 6),
    ("access", "identifier", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", "secret", r"[0-9a-f]{24,}", 0, 24),
    ("client", "identifier", r"""(?i:(?:client|app|account)_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_-]+)""", 1, 6),
    ("key", "secret", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    ("endpoint", "endpoint", r"https?://[A-Za-z0-9][A-Za-z0-9.:/_-]*", 0, 12),
]
BASE = 3
#: A cheaper pattern that every match contains.
QUICK = ["(?i)passw|secret|token|api_?key", "AKIA", "[0-9a-f]{24}", "(?i)(?:client|app|account)_?id", "[A-Za-z0-9+/]{40}", "https?://"]

_SPAN = "struct<at:int,rank:int,stop:int>"


def _running(items: Column, rank: int) -> Column:
    """Spans from (gap, n, ok) in order of the text: a fold over blocks, so that appending stays cheap."""

    def step(acc, x):
        at = acc["pos"] + x["gap"]
        span = F.struct(at.alias("at"), F.lit(rank).alias("rank"), (at + x["n"]).alias("stop"))
        out = F.concat(acc["out"], F.when(x["ok"], F.array(span)).otherwise(F.array().cast(f"array<{_SPAN}>")))
        return F.struct((at + x["n"]).alias("pos"), out.alias("out"))

    def start(pos):
        return F.struct(pos.cast("int").alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def block(acc, i):
        part = F.slice(items, i * BLOCK + 1, F.lit(BLOCK))
        inner = F.aggregate(part, start(acc["pos"]), step)
        return F.struct(inner["pos"].alias("pos"), F.concat(acc["out"], inner["out"]).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    return F.aggregate(blocks, start(F.lit(0)), block)["out"]


def _spans(text: Column, rank: int) -> Column:
    """All matches of one kind as an array of spans."""
    _, _, pattern, group, least = KINDS[rank]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    n = F.size(found)
    items = F.zip_with(
        F.slice(between, 1, n),
        F.arrays_zip(found.alias("m"), counted.alias("c")),
        lambda a, b: F.struct(F.char_length(a).alias("gap"), F.char_length(b["m"]).alias("n"), (F.char_length(b["c"]) >= least).alias("ok")),
    )
    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(text.rlike(QUICK[rank]), F.when(n > 0, _running(items, rank)).otherwise(none)).otherwise(none)


def parts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, row (tells texts of one id apart), and all candidates, base and weak, in order."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("row"), body.alias("body"))
    return rows.select("doc_id", "row", F.concat(*[_spans(F.col("body"), i) for i in range(len(KINDS))]).alias("parts"))


def _binned(df: DataFrame, margin: int) -> DataFrame:
    low, high = F.floor((F.col("at") - margin) / SCOPE), F.floor((F.col("stop") + margin) / SCOPE)
    return df.withColumn("bin", F.explode(F.sequence(low, high)))


def linked(found: DataFrame) -> DataFrame:
    """The weak candidates whose complementary parts lie within the scope: doc_id, row, added spans."""
    some = found.filter(F.exists("parts", lambda x: x["rank"] >= BASE)).dropDuplicates(["doc_id", "row"])
    each = some.select("doc_id", "row", F.explode("parts").alias("p")).select("doc_id", "row", "p.*")
    of_role = {role: [i for i, k in enumerate(KINDS) if k[1] == role] for role in ("identifier", "secret", "endpoint")}

    def near(weak: DataFrame, role: str) -> DataFrame:
        other = _binned(each.filter(F.col("rank").isin(of_role[role])), 0).alias("o")
        left = _binned(weak, SCOPE).alias("w")
        same = F.col("w.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("w.row") == F.col("o.row")) & (F.col("w.bin") == F.col("o.bin"))
        close = F.greatest("w.at", "o.at") - F.least("w.stop", "o.stop") <= SCOPE
        return left.join(other, same & close, "left_semi").drop("bin").distinct()

    weak = {role: each.filter(F.col("rank").isin([i for i in ranks if i >= BASE])) for role, ranks in of_role.items()}
    kept = [near(weak["identifier"], "secret"), near(weak["secret"], "identifier"), near(near(weak["endpoint"], "identifier"), "secret")]
    return reduce(DataFrame.unionByName, kept).groupBy("doc_id", "row").agg(F.collect_list(F.struct("at", "rank", "stop")).alias("added"))


def spell(spans: Column) -> Column:
    """Spans in order of start, then kind, as kind:start:end joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["at"].cast("string"), x["stop"].cast("string"))))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, base and all spans as arrays of (at, rank of the kind, stop)."""
    found = cut(parts(docs, text, key))
    added = linked(found)
    same = F.col("f.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("f.row") == F.col("a.row"))
    joined = found.alias("f").join(added.alias("a"), same, "left")
    base = F.filter("f.parts", lambda x: x["rank"] < BASE)
    return joined.select(F.col("f.doc_id").alias("doc_id"), base.alias("base"), F.concat(base, F.coalesce("a.added", F.array().cast(f"array<{_SPAN}>"))).alias("spans"))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank][0]}")

    counts = [count(i) for i in range(BASE)]
    return found.select("doc_id", *counts, F.sha2(spell(F.col("base")), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"))
