"""Alignment of two revisions, and what follows for the annotations attached to them.

A unit is what is aligned as a whole, a paragraph say. Units of equal length are compared place by place; in others the equal ends are
anchored by hashes of their sentences from the front and from the back, and what lies between is one edit that must be told apart: only there, and
only where it has three sentences at most, are texts gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .lineage import staged

SPLIT_OR_MERGE, SCRAMBLED = 0.90, 0.25


def _sided(df: DataFrame, size: str) -> DataFrame:
    """unit, k (place from 0), ``size``, id, norm."""
    order = Window.partitionBy("unit").orderBy("place")
    rows = df.withColumn("k", F.row_number().over(order) - 1).withColumn(size, F.count("*").over(Window.partitionBy("unit")).cast("int"))
    return rows.select("unit", "k", size, *([F.col("id").cast("string").alias("id")] if "id" in df.columns else []), X.normalise(F.col("text")).alias("norm"))


def _changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """unit, m, n, head, tail, differ: of units that differ in any text, those of one side only too, the numbers of sentences, of equal ones at both ends, and the places that differ where m = n.

    Normalised sentences are compared by two hashes; only hashes are gathered.
    """

    def content(df: DataFrame, h: str, size: str) -> DataFrame:
        norm = X.normalise(F.col("text"))
        pair = lambda c: [F.xxhash64(c), F.xxhash64(F.lit(1), c)]
        rows = df.select("unit", "place", *[x.alias(n) for n, x in zip("abcd", pair(F.col("text")) + pair(norm))])
        return rows.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("place", "a", "b", "c", "d"))).alias(h), F.count("*").cast("int").alias(size))

    both = content(old, "x", "m").join(content(new, "y", "n"), "unit", "full")
    told = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in "mn"})
    of = lambda c, p, q: F.transform(c, lambda v: F.struct(v[p].alias("p"), v[q].alias("q")))
    told = told.filter(~of("x", "a", "b").eqNullSafe(of("y", "a", "b"))).select("unit", "m", "n", of("x", "c", "d").alias("x"), of("y", "c", "d").alias("y"))
    least = F.least("m", "n")

    def apart(x: Column, y: Column) -> Column:
        places = F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda k: F.get(x, k) != F.get(y, k))

    told = told.withColumn("differ", apart(F.col("x"), F.col("y"))).withColumn("behind", apart(F.reverse("x"), F.reverse("y")))
    head = F.coalesce(F.get("differ", F.lit(0)), least)
    tail = F.least(F.coalesce(F.get("behind", F.lit(0)), least), least - head)
    return told.select("unit", "m", "n", head.alias("head"), tail.alias("tail"), F.when(F.col("m") == F.col("n"), F.col("differ")).alias("differ"))


def align(old: DataFrame, new: DataFrame) -> DataFrame:
    """A plan for each changed unit, from (unit, id, place, text) and (unit, place, text): unit, action, old_id, survivor, place.

    ``keep`` has the new place, ``split`` that of the second half, ``merge`` the survivor, ``insert`` and ``delete`` what they say; a unit whose change
    cannot be told apart, or whose sentence at some place has hardly anything in common with the old one, has one ``conflict`` alone. Equal units need
    none. Places are those in the unit's order; equal places of one unit are an error of the caller.
    """
    units = staged(_changed(old, new))
    a = staged(_sided(old.join(units.select("unit"), "unit", "left_semi"), "m"))
    b = staged(_sided(new.join(units.select("unit"), "unit", "left_semi"), "n"))
    # Only places of equally long units that differ bring their texts along.
    differ = staged(units.select("unit", F.explode("differ").alias("k")))
    texts = a.join(differ, ["unit", "k"]).select("unit", "k", "norm").join(b.join(differ, ["unit", "k"]).select("unit", "k", F.col("norm").alias("other")), ["unit", "k"])
    bad = texts.filter(X.similar(F.col("norm"), F.col("other")) < SCRAMBLED).select("unit").distinct().withColumn("scrambled", F.lit(True))
    told = units.drop("differ").join(bad, "unit", "left").withColumn("even", F.col("m") == F.col("n"))
    told = told.withColumn("x", F.col("m") - F.col("head") - F.col("tail")).withColumn("y", F.col("n") - F.col("head") - F.col("tail"))
    few = told.filter(~F.col("even") & (F.col("x") + F.col("y") == 3) & (F.col("x") > 0) & (F.col("y") > 0))

    def middle(side: DataFrame, size: str, columns: list[str], name: str) -> DataFrame:
        inside = (F.col("k") >= F.col("head")) & (F.col("k") < F.col(size) - F.col("tail"))
        rows = side.drop(size).join(few, "unit").filter(inside)
        return rows.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("k", *columns))).alias(name))

    met = middle(a, "m", ["id", "norm"], "olds").join(middle(b, "n", ["norm"], "news"), "unit")
    whole = [F.array_join(F.transform(c, lambda x: x["norm"]), " ") for c in ("olds", "news")]
    near = met.filter(X.similar(*whole) >= SPLIT_OR_MERGE).select("unit", F.transform("olds", lambda x: x["id"]).alias("ids"))
    told = told.join(near, "unit", "left")
    clear = F.when(F.col("even"), ~F.coalesce("scrambled", F.lit(False))).otherwise(F.col("ids").isNotNull() | (F.col("x") + F.col("y") == 1))
    told = staged(told.withColumn("clear", clear))

    none = F.lit(None).cast("string")

    def step(action: str, old_id: Column, survivor: Column, place: Column | None) -> Column:
        return F.struct(F.lit(action).alias("action"), old_id.alias("old_id"), survivor.alias("survivor"), (F.lit(None) if place is None else place).cast("int").alias("place"))

    kept = a.select("unit", "k", "id").join(told.filter("clear").drop("ids"), "unit")
    kept = kept.filter(F.col("even") | (F.col("k") < F.col("head")) | (F.col("k") >= F.col("m") - F.col("tail")))
    place = F.when(F.col("even") | (F.col("k") < F.col("head")), F.col("k")).otherwise(F.col("k") + F.col("n") - F.col("m"))
    keeps = kept.select("unit", step("keep", F.col("id"), F.col("id"), place).alias("s"))
    gone = a.select("unit", "k", "id").join(told.filter("clear AND NOT even AND x = 1 AND y = 0").drop("ids"), "unit").filter("k = head").select("unit", step("delete", F.col("id"), none, None).alias("s"))
    first, second, head = F.get("ids", F.lit(0)), F.get("ids", F.lit(1)), F.col("head")
    halves = F.array(step("keep", first, first, head), step("split", first, first, head + 1))
    merged = F.array(step("keep", first, first, head), step("merge", second, first, head))
    single = F.when(~F.col("clear"), F.array(step("conflict", none, none, None))).when(F.col("ids").isNotNull() & (F.col("x") == 1), halves).when(F.col("ids").isNotNull(), merged)
    single = single.when(~F.col("even") & (F.col("x") == 0) & (F.col("y") == 1), F.array(step("insert", none, none, head)))
    rest = told.withColumn("steps", single).filter("steps IS NOT NULL").select("unit", F.explode("steps").alias("s"))
    return keeps.unionByName(gone).unionByName(rest).select("unit", "s.*")


def repoint(anchors: DataFrame, plan: DataFrame, columns: list[str]) -> DataFrame:
    """Anchors on merged sentences go to their survivors."""
    moved = plan.filter("action = 'merge'").select(F.col("old_id").alias("_from"), F.col("survivor").alias("_to"))
    for c in columns:
        anchors = anchors.join(moved, F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")
    return anchors


def extend(anchors: DataFrame, splits: DataFrame, start: str, end: str) -> DataFrame:
    """Anchors on one sentence that was split (old_id, second) reach over its second half; ranges stay."""
    halves = splits.select(F.col("old_id").alias("_from"), F.col("second").alias("_second"))
    joined = anchors.join(halves, F.col(start) == F.col("_from"), "left")
    return joined.withColumn(end, F.when(F.col(end).isNull(), F.col("_second")).otherwise(F.col(end))).drop("_from", "_second")


def refused(plan: DataFrame, anchors: DataFrame, column: str) -> DataFrame:
    """Deletions that would take an anchor with them: unit, old_id, anchors."""
    gone = plan.filter("action = 'delete'")
    return gone.join(anchors, gone.old_id == anchors[column]).groupBy("unit", "old_id").agg(F.count("*").alias("anchors"))


def not_additive(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Pre-flight: keys that went, or whose order among the kept ones changed."""
    removed = old.join(new.select(key), key, "left_anti").select(key, F.lit("removed").alias("reason"))
    kept = old.select(key, F.col(order).alias("_a")).join(new.select(key, F.col(order).alias("_b")), key)
    # Ranges of _a, each in a task; what lies before a range's first row is the last row of the range before it.
    dealt = staged(kept.repartitionByRange("_a").withColumn("_r", F.spark_partition_id()))
    seams = dealt.groupBy("_r").agg(F.max_by("_b", "_a").alias("_last")).withColumn("_last", F.lag("_last").over(Window.orderBy("_r")))
    before = F.coalesce(F.lag("_b").over(Window.partitionBy("_r").orderBy("_a")), "_last")
    moved = dealt.join(F.broadcast(seams), "_r").withColumn("_m", before > F.col("_b")).filter("_m")
    return removed.unionByName(moved.select(key, F.lit("moved").alias("reason")))
