"""Trees and parent edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import staged


def ancestors(df: DataFrame, path: str) -> DataFrame:
    """Each row once per ancestor-or-self path of an array column, as ``ancestor``: equi-joins then replace prefix tests."""
    return df.withColumn("ancestor", F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(F.col(path), 1, n))))


def effective(df: DataFrame, values: DataFrame, path: str, value: str, name: str) -> DataFrame:
    """The value of the deepest ancestor-or-self that has one; null where none has."""
    own = values.filter(F.col(value).isNotNull()).select(F.col(path).alias("ancestor"), F.col(value).alias("_v"))
    found = ancestors(df, path).join(own, "ancestor").groupBy(path).agg(F.max_by("_v", F.size("ancestor")).alias(name))
    return df.join(found, path, "left")


def _edges(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """_n, _up: each node's known parent, itself where there is none."""
    known = edges.select(F.col(node).alias("_p")).distinct()
    return edges.join(_wide(known), F.col(parent) == F.col("_p"), "left").select(F.col(node).alias("_n"), F.coalesce("_p", node).alias("_up"))


def _wide(df: DataFrame) -> DataFrame:
    """Joined by a shuffle: columns of keys in order compress so well that their files look small enough to be sent through the driver."""
    return df.hint("merge")


def _doubled(jump: DataFrame) -> DataFrame:
    far = jump.select(F.col("_n").alias("_m"), F.col("_up").alias("_top"))
    return staged(jump.join(_wide(far), F.col("_up") == F.col("_m")).select("_n", F.col("_top").alias("_up")))


def _settled(jump: DataFrame) -> DataFrame:
    """_n, _up: a node so far up that only roots and nodes of cycles remain as _up: doubled until their number stays."""
    seen = None
    while True:
        found = jump.agg(F.count_distinct("_up")).first()[0]
        if found == seen:
            return jump
        seen, jump = found, _doubled(jump)


def roots(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """node, root: parents followed to the top by doubling, so the rounds grow with the depth's logarithm, without a limit.

    An edge to an unknown node stops there at the last known one. A walk that meets a node again ends there: a node of a cycle is its own
    root, and what leads into a cycle has the node where it enters it.
    """
    once = staged(_edges(edges, node, parent))
    ends = _settled(once).select(F.col("_up").alias("_e")).distinct()
    jump = once.join(_wide(ends), F.col("_n") == F.col("_e"), "left").select("_n", F.when(F.col("_e").isNotNull(), F.col("_n")).otherwise(F.col("_up")).alias("_up"))
    moved = True
    while moved:
        after = _doubled(jump)
        moved = not after.join(_wide(jump.toDF("_n", "_before")), "_n").filter("_up <> _before").isEmpty()
        jump = after
    return jump.select(F.col("_n").alias(node), F.col("_up").alias("root"))


def cyclic(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """The nodes from which following parents never ends, at any depth."""
    once = staged(_edges(edges, node, parent))
    looped = once.filter("_n <> _up").select(F.col("_n").alias("_c"))
    return _settled(once).join(_wide(looped), F.col("_up") == F.col("_c"), "left_semi").select(F.col("_n").alias(node))


def _levels(df: DataFrame, node: str, parent: str) -> int:
    """How deep the trees are; raises if some rows hang on no root."""
    level, n, rest = staged(df.filter(F.col(parent).isNull()).select(node)), 0, df.count()
    while size := level.count():
        n, rest = n + 1, rest - size
        level = staged(df.join(level.select(F.col(node).alias("_p")), F.col(parent) == F.col("_p"), "left_semi").select(node))
    if rest:
        raise ValueError(f"{rest} rows of the forest hang on no root")
    return n


def forest(df: DataFrame, node: str, parent: str, order: str) -> DataFrame:
    """Trees as nested arrays: roots with ``children`` in order, built from the leaves upwards; rows that hang on no root are an error."""
    levels = _levels(df, node, parent)
    built = df.select(node, parent, order, F.array().cast("array<string>").alias("children"))
    for _ in range(levels - 1):
        packed = F.to_json(F.struct(node, "children"))
        groups = built.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_p")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, packed.alias("j")))), lambda x: x["j"]).alias("_c"))
        built = df.join(groups, F.col(node) == F.col("_p"), "left").select(node, parent, order, F.coalesce("_c", F.array().cast("array<string>")).alias("children"))
    return built.filter(F.col(parent).isNull()).select(node, order, "children")


def outline(df: DataFrame, node: str, parent: str, order: str) -> DataFrame:
    """Trees of any depth as typed rows in reading order: adds ``root``, ``level``, ``place`` (from 0 in its tree, parents before children), ``children`` (in order) and ``path``.

    A path is the (order, node) keys from the root down; arrays sort a parent before its children, so one sort lays out a tree. Paths
    grow by doubling, so the joins grow with the depth's logarithm. A row whose parent is unknown is a root; cycles are an error.
    """
    known = df.select(F.col(node).alias("_p")).distinct()
    key = F.struct(F.col(order).alias("order"), F.col(node).alias("node"))
    walk = staged(df.join(known, F.col(parent) == F.col("_p"), "left").select(F.col(node).alias("_n"), F.col("_p").alias("_up"), F.array(key).alias("path")))
    left = walk.filter("_up IS NOT NULL").count()
    while left:
        far = walk.select(F.col("_n").alias("_m"), F.col("_up").alias("_far"), F.col("path").alias("_above"))
        joined = walk.join(far, F.col("_up") == F.col("_m"), "left")
        walk = staged(joined.select("_n", F.col("_far").alias("_up"), F.when(F.col("_m").isNotNull(), F.concat("_above", "path")).otherwise(F.col("path")).alias("path")))
        before, left = left, walk.filter("_up IS NOT NULL").count()
        if left == before:
            raise ValueError(f"{left} rows of the trees hang on a cycle")
    told = walk.select("_n", "path", F.col("path")[0]["node"].alias("root"), F.size("path").alias("level"))
    placed = told.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("path")) - 1)
    lists = df.join(known, F.col(parent) == F.col("_p")).groupBy("_p").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["node"]).alias("children"))
    out = df.join(placed, F.col(node) == F.col("_n")).join(lists, F.col(node) == F.col("_p"), "left")
    return out.withColumn("children", F.coalesce("children", F.array().cast(lists.schema["children"].dataType))).drop("_n", "_p")


def paths(df: DataFrame, keys: list[str], order: list[str], depth: str, label: str) -> DataFrame:
    """Paths from a list coded by depth, as deep as it goes: the last label of each smaller depth before a row, closed by any shallower row."""
    levels = (df.agg(F.max(depth)).first()[0] or 0) + 1
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for d in range(levels):
        opened = F.last(F.when(F.col(depth) <= d, F.struct(F.col(depth).alias("d"), F.col(label).alias("l"))), ignorenulls=True).over(window)
        out = out.withColumn(f"_l{d}", F.when((F.col(depth) >= d) & (opened["d"] == d), opened["l"]))
    steps = F.filter(F.array(*[F.col(f"_l{d}") for d in range(levels)]), lambda x: x.isNotNull())
    return out.withColumn("path", steps).drop(*[f"_l{d}" for d in range(levels)])
