"""Merkle dataset manifest (13): each parent keeps its preimage, the concatenated hashes of its children.

Leaves are numbered in their group by one range sort with counts per range, so that a group of any size is spread. Trees are cut
into blocks of ``2 ** LEVELS`` consecutive nodes: a block's levels are computed inside its row, and the blocks' tops are
the nodes of the next stage, which is a thousandth of it; a stage a thousandfold, not one a level. The stored table of parents has, per
block and level, the parents' preimages. On the way down a block's nodes join the preimages of their ancestors: a node's path
is, level by level, its parent's preimage and its own slot of 64 characters in it. Cutting the slot out leaves the
siblings, and putting another hash into it folds the path to another root.

Groups are the languages, and their roots are the leaves of one last tree. A null in any column has its own encoding and a null language is
a group of its own, ordered first; a null doc_id comes first and is never tampered with; rows of equal doc_id
follow in order of their leaves, equal rows give equal leaves at different places; a null or empty or very long text is hashed whole like
any other; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import cut, partitions, small

ARITY, LEVELS, HEX = 2, 10, 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def encoded(values: list[Column]) -> Column:
    """Each value as its number of bytes, a colon and itself, nulls as a dash."""

    def one(x: Column) -> Column:
        x = x.cast("string")
        return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))

    return F.concat(*[one(x) for x in values])


def leaves(docs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> Column:
    return digest(encoded([F.col(c) for c in columns]))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place``: from 0 in each ``grp``, by ``order``, nulls first; written, so that places stay."""
    dealt = nodes.repartitionByRange(partitions(nodes.sparkSession), "grp", *order).sortWithinPartitions("grp", *order)
    rows = cut(dealt.select("*", F.monotonically_increasing_id().alias("_id")))
    part = F.shiftright("_id", 33)
    earlier = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("grp", part.alias("_part")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    ranges = cut(ranges.select("grp", "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")))
    met = rows.alias("r").join(small(ranges).alias("b"), (F.shiftright("r._id", 33) == F.col("b._part")) & F.col("r.grp").eqNullSafe(F.col("b.grp")))
    return met.select("r.*", (F.col("r._id") - F.col("b._first") + F.col("b._base")).alias("place")).drop("_id")


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """grp, block, nodes (in order: hash and payload), at most ``ARITY ** LEVELS`` a row."""
    node = F.struct("place", "hash", *payload)
    return nodes.groupBy("grp", F.floor(F.col("place") / ARITY**LEVELS).alias("block")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))


def _height(n: Column) -> Column:
    """Levels above n nodes."""
    return reduce(lambda x, k: x + F.when(n > F.lit(ARITY**k).cast("decimal(38,0)"), 1).otherwise(0), range(60), F.lit(0))


def _tiers(hashes: Column, levels: Column) -> Column:
    """The preimages of all parents in a block, level by level, and ``top``: the node that is left, if the levels end in one."""

    def up(acc: Column, _: Column) -> Column:
        below = acc["nodes"]
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / ARITY).cast("int"))
        preimages = F.transform(runs, lambda i: F.array_join(F.slice(below, i * ARITY + 1, F.lit(ARITY)), ""))
        return F.struct(F.transform(preimages, digest).alias("nodes"), F.concat(acc["tiers"], F.array(preimages)).alias("tiers"))

    steps = F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), F.lit(1), levels)
    return F.aggregate(steps, F.struct(hashes.alias("nodes"), F.array().cast("array<array<string>>").alias("tiers")), up)


def grown(nodes: DataFrame, payload: list[str]) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """The stages' blocks of nodes, their parents' preimages (grp, block, tiers), and the groups' roots (grp, root). ``nodes``: grp, place, hash."""
    stages, parents, height = [], [], 0
    sizes = cut(nodes.groupBy("grp").agg(F.count("*").alias("n")).select("grp", _height(F.col("n")).alias("height")))
    highest = sizes.agg(F.max("height")).first()[0] or 0
    while True:
        blocks = cut(_blocks(nodes, payload))
        left = F.least(F.greatest(F.col("s.height") - height, F.lit(0)), F.lit(LEVELS))
        met = blocks.alias("b").join(small(sizes).alias("s"), F.col("b.grp").eqNullSafe(F.col("s.grp")))
        tiers = met.select("b.grp", "b.block", _tiers(F.col("b.nodes.hash"), left).alias("t"))
        table = cut(tiers.select("grp", "block", F.col("t.tiers").alias("tiers"), F.get("t.nodes", F.lit(0)).alias("top")))
        stages.append(blocks)
        parents.append(table)
        nodes, payload, height = table.select("grp", F.col("block").alias("place"), F.col("top").alias("hash")), [], height + LEVELS
        if height >= highest:
            return stages, parents, nodes.select("grp", F.col("hash").alias("root"))


def paths(stages: list[DataFrame], parents: list[DataFrame], payload: list[str]) -> DataFrame:
    """grp, hash, payload, path of each leaf: (preimage, slot) from its parent to the root of its group."""
    above = None
    for blocks, table in zip(reversed(stages), reversed(parents)):
        met = blocks.alias("b").join(table.alias("t"), F.col("b.grp").eqNullSafe(F.col("t.grp")) & (F.col("b.block") == F.col("t.block")))
        met = met.select("b.grp", "b.block", "b.nodes", "t.tiers")
        if above is None:
            met = met.withColumn("above", F.array().cast("array<struct<preimage:string,slot:int>>"))
        else:
            met = met.alias("m").join(small(above).alias("a"), F.col("m.grp").eqNullSafe(F.col("a.grp")) & (F.col("m.block") == F.col("a.place"))).select("m.*", F.col("a.path").alias("above"))

        def leaf(node: Column, i: Column) -> Column:
            def step(tier: Column, j: Column) -> Column:
                own = F.floor(i / F.pow(F.lit(ARITY), j)).cast("int")
                return F.struct(F.get(tier, F.floor(own / ARITY).cast("int")).alias("preimage"), (own % ARITY).alias("slot"))

            return node.withField("path", F.concat(F.transform("tiers", step), "above"))

        each = met.select("grp", F.explode(F.transform("nodes", leaf)).alias("node")).select("grp", "node.*")
        if blocks is stages[0]:
            return each.select("grp", "hash", *payload, "path")
        above = cut(each.select("grp", "place", "path"))
    raise AssertionError


def siblings(path: Column) -> Column:
    """All siblings' hashes from below, end to end: each preimage without the own slot."""
    return F.array_join(F.transform(path, lambda p: F.concat(F.substring(p["preimage"], F.lit(1), p["slot"] * HEX), F.substring(p["preimage"], p["slot"] * HEX + HEX + 1, F.lit(ARITY * HEX)))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf put into its slot of each preimage in turn."""
    return F.aggregate(path, leaf, lambda h, p: digest(F.concat(F.substring(p["preimage"], F.lit(1), p["slot"] * HEX), h, F.substring(p["preimage"], p["slot"] * HEX + HEX + 1, F.lit(ARITY * HEX)))))


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, leaf, altered (a leaf of other values, or null), subroot, root, and path: preimages and slots up to the root."""
    altered = F.lit(None).cast("string") if altered is None else altered
    rows = cut(docs.select(F.col("lang").cast("string").alias("grp"), "doc_id", leaves(docs).alias("hash"), altered.alias("altered")))
    stages, parents, roots = grown(numbered(rows, ["doc_id", "hash"]), ["doc_id", "altered"])
    tops = numbered(roots.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), F.col("root").alias("hash")), ["name"])
    top_stages, top_parents, root = grown(tops, ["name"])
    upper = paths(top_stages, top_parents, ["name"]).crossJoin(F.broadcast(root.select("root")))  # one row
    upper = cut(upper.select("name", F.col("hash").alias("subroot"), "root", F.col("path").alias("upper")))
    each = paths(stages, parents, ["doc_id", "altered"]).alias("e").join(small(upper).alias("u"), F.col("e.grp").eqNullSafe(F.col("u.name")))
    return each.select("e.doc_id", F.col("e.hash").alias("leaf"), "e.altered", "u.subroot", "u.root", F.concat("e.path", "u.upper").alias("path"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = digest(encoded([F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in COLUMNS]))
    found = manifest(docs, F.when(tampered, changed))
    found = found.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = """
WITH RECURSIVE coded AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z FROM documents),
hashed AS (
  SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || z) AS leaf,
    sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || z) AS other FROM coded),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (
  SELECT lang, 0 AS level, place, leaf AS hash, n FROM leaves
  UNION ALL SELECT lang, level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2, n),
subroots AS (SELECT lang, hash AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, subroot AS hash, n FROM subroots
  UNION ALL SELECT level + 1, place // 2, sha256(string_agg(hash, '' ORDER BY place)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, place // 2, n),
root AS (SELECT hash AS root, level AS height FROM tops WHERE n = 1),
steps AS (
  SELECT l.lang, l.place, k AS step, (l.place >> k) & 1 AS slot, coalesce(x.hash, '') AS sibling
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, LATERAL (SELECT unnest(range(s.height)) AS k)
  LEFT JOIN nodes x ON x.lang IS NOT DISTINCT FROM l.lang AND x.level = k AND x.place = xor(l.place >> k, 1)
  UNION ALL SELECT l.lang, l.place, s.height + k, (s.place >> k) & 1, coalesce(x.hash, '')
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root, LATERAL (SELECT unnest(range(root.height)) AS k)
  LEFT JOIN tops x ON x.level = k AND x.place = xor(s.place >> k, 1)),
crc AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS rest, 4294967295 AS c, 0 AS bits FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, CASE WHEN bits = 0 THEN rest[2:] ELSE rest END,
    CASE WHEN bits = 0 THEN xor(c, ascii(rest)) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CASE WHEN bits = 0 THEN 8 ELSE bits - 1 END
  FROM crc WHERE rest <> '' OR bits > 0),
tampered AS (SELECT doc_id FROM crc WHERE rest = '' AND bits = 0 AND xor(c, 4294967295) % 7 = 0),
folds AS (
  SELECT l.lang, l.place, 0 AS step, CASE WHEN t.doc_id IS NULL THEN leaf ELSE other END AS h FROM leaves l LEFT JOIN tampered t ON l.doc_id = t.doc_id
  UNION ALL SELECT f.lang, f.place, f.step + 1, sha256(CASE s.slot WHEN 0 THEN h || sibling ELSE sibling || h END)
  FROM folds f JOIN steps s ON f.lang IS NOT DISTINCT FROM s.lang AND f.place = s.place AND f.step = s.step),
ends AS (SELECT lang, place, arg_max(h, step) AS folded_root FROM folds GROUP BY ALL),
proofs AS (SELECT lang, place, string_agg(sibling, '' ORDER BY step) AS p FROM steps GROUP BY ALL)
SELECT l.doc_id, l.leaf, s.subroot, root.root, sha256(coalesce(p.p, '')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root JOIN ends e ON e.lang IS NOT DISTINCT FROM l.lang AND e.place = l.place
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.place = l.place"""
