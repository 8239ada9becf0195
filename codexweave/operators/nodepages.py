"""Pages of a book's nodes with all that stands in them: blocks, sentences, page marks, footnotes and margin notes.

Requests are rows. Their nodes are found by place: cursors are counted among a book's nodes by a window over keys, and places meet
nodes by an equi-join of ``size`` rows a request, so no request meets its whole book. What a node holds is gathered from the leaves up, each
level under its parent's key; the largest group is one node's content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_children(rows: DataFrame, key: str, children: DataFrame, name: str, order: str, within: str | None = None) -> DataFrame:
    """Add array ``name``: the children of each row, which carry its ``key``, as structs by ``order``; empty for rows without any.

    ``within``: a column of both that children share with their row, too, and that isn't part of the structs. Tables dealt by it are not shuffled.
    """
    keys = [key] if within in (None, key) else [within, key]
    item = F.struct(order, *[F.col(f"`{c}`") for c in children.columns if c not in (*keys, order)])
    gathered = children.filter(F.col(key).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(name))
    kind = gathered.schema[name].dataType
    return rows.join(gathered, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def shown(rows: DataFrame, original: bool) -> DataFrame:
    """Columns named original_* are null unless asked for."""
    hidden = {c: F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns if c.startswith("original_") and not original}
    return rows.withColumns(hidden) if hidden else rows


def contents(blocks: DataFrame, sentences: DataFrame, markers: DataFrame, notes: dict[str, tuple[DataFrame, DataFrame]], original: bool = False, within: str | None = None) -> DataFrame:
    """node, blocks: an array by position, sentences within each.

    ``blocks``: node, block, position, figure_number; ``sentences``: block, sentence, position; ``markers``: sentence, sort_order. ``notes``: for the name of each kind
    its notes (sentence, note, number) and their sentences (note, position). All may have further columns, which are carried along. A figure's
    number stands on its sentences too. Parts whose parent is null or missing are in no node.
    ``within``: ``node``, if all tables have it: they are dealt by it as they come, or else shuffled by it, and then no level is shuffled again.
    """
    told = with_children(shown(sentences, original), "sentence", markers, "markers", "sort_order", within)
    for name, (heads, bodies) in notes.items():
        whole = with_children(heads, "note", shown(bodies, original), "sentences", "position", within)
        told = with_children(told, "sentence", whole, name, "number", within)
    held = with_children(shown(blocks, original), "block", told, "sentences", "position", within)
    held = held.withColumn("sentences", F.transform("sentences", lambda s: s.withField("figure_number", F.col("figure_number"))))
    nodes = held.select("node").filter("node IS NOT NULL").distinct()
    return with_children(nodes, "node", held, "blocks", "position")


def page_bounds(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """request, book, first, last (places among the book's nodes from 1), has_more, has_previous.

    ``requests``: request, book, after, before, size; ``before`` asks backwards and goes before ``after``, neither for the start. ``nodes``: book, sort_order, unique in a book.
    An empty page has neither more nor previous. Forwards, nodes are previous where the first one's sort_order is above 0.
    """
    back = F.col("before").isNotNull()
    cursor = requests.select("request", "book", "size", back.alias("back"), F.coalesce("before", "after", F.lit(-1)).cast("long").alias("at"), F.when(back, -1).otherwise(1).alias("tie"), F.lit(0).alias("one"))
    keys = nodes.select("book", F.col("sort_order").cast("long").alias("at"), F.lit(0).alias("tie"), F.lit(1).alias("one"))
    book = Window.partitionBy("book")
    counted = cursor.unionByName(keys, allowMissingColumns=True)
    counted = counted.withColumn("n", F.sum("one").over(book)).withColumn("passed", F.sum("one").over(book.orderBy("at", "tie")))
    counted = counted.filter("request IS NOT NULL")
    first = F.when(F.col("back"), F.greatest(F.col("passed") - F.col("size") + 1, F.lit(1))).otherwise(F.col("passed") + 1)
    last = F.when(F.col("back"), F.col("passed")).otherwise(F.least(F.col("passed") + F.col("size"), F.col("n")))
    ends = counted.select("request", "book", "back", "n", first.alias("first"), last.alias("last"))
    lowest = placed(nodes).select("book", F.col("place").alias("first"), F.col("sort_order").alias("low"))
    full = F.col("first") <= F.col("last")
    previous = F.when(F.col("back"), F.col("first") > 1).otherwise(F.coalesce(F.col("low") > 0, F.lit(False)))
    return ends.join(lowest, ["book", "first"], "left").select("request", "book", "first", "last", (full & (F.col("last") < F.col("n"))).alias("has_more"), (full & previous).alias("has_previous"))


def placed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("book").orderBy("sort_order")).cast("long"))


def pages(requests: DataFrame, nodes: DataFrame, held: DataFrame) -> DataFrame:
    """request, has_more, has_previous, nodes: an array by sort_order, each node with its ``blocks`` from ``contents``; one row a request."""
    bounds = page_bounds(requests, nodes)
    wanted = bounds.filter("first <= last").select("request", "book", F.explode(F.sequence("first", "last")).alias("place"))
    filled = placed(nodes).join(held, "node", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(held.schema["blocks"].dataType)))
    items = wanted.join(filled, ["book", "place"]).drop("book", "place")
    return with_children(bounds.select("request", "has_more", "has_previous"), "request", items, "nodes", "sort_order")
