"""Filters and keys that depend on parameters, viewers and cases, and the sorts and pages of the reading views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shown_if(df: DataFrame, columns: list[str], shown: bool) -> DataFrame:
    """The columns as they are, or null with their types kept."""
    return df if shown else df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})


def optional(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows equal to every value that is set; None restricts nothing."""
    return reduce(lambda d, x: d.filter(F.col(x[0]) == x[1]), [(c, v) for c, v in wanted.items() if v is not None], df)


def among(df: DataFrame, column: str, values: list | DataFrame) -> DataFrame:
    """Rows whose column is one of the values; an empty set gives no rows, without reading any."""
    if isinstance(values, DataFrame):
        return df.join(values.toDF(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(values)) if values else df.filter(F.lit(False))


def visible(status: Column, owner: Column, viewer: Column, archived: Column) -> Column:
    """Approved, or the viewer's own and pending, and not archived; without a viewer only what is approved."""
    return F.coalesce((status == "approved") | ((owner == viewer) & (status == "pending")), F.lit(False)) & ~archived


def contains(column: Column, text: str, escaped: bool = True) -> Column:
    """Contains, whatever the case. Escaped, ``%``, ``_`` and ``\\`` stand for themselves; otherwise they are wildcards."""
    if escaped:
        text = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{text}%")


def case_keyed(left: DataFrame, right: DataFrame, branches: list[tuple[Column, list[Column]]], keys: list[str]) -> DataFrame:
    """Left join on keys that a CASE chooses for each row: computed first, so that an equi-join remains."""
    names = [f"_k{i}" for i in range(len(keys))]
    for i, name in enumerate(names):
        chosen = reduce(lambda acc, b: F.when(b[0], b[1][i]).otherwise(acc), reversed(branches), F.lit(None))  # noqa: B023
        left = left.withColumn(name, chosen)
    other = right.withColumnsRenamed(dict(zip(keys, (f"_r{i}" for i in range(len(keys))))))
    on = reduce(Column.__and__, [F.col(n) == F.col(f"_r{i}") for i, n in enumerate(names)])
    return left.join(other, on, "left").drop(*names, *[f"_r{i}" for i in range(len(keys))])


def restricted_left(left: DataFrame, right: DataFrame, keys: list[str], column: str, allowed: DataFrame) -> DataFrame:
    """Left join with right rows whose ``column`` is in ``allowed``: the right side is restricted first, so left rows all stay."""
    return left.join(among(right, column, allowed), keys, "left")


def anchored_page(df: DataFrame, order: str, anchor: int, back: int, size: int) -> DataFrame:
    """A page around an anchor: from ``back`` rows before it, ``size`` rows further, clamped to 1..50; with has_more and has_previous."""
    size, back = max(1, min(50, size)), max(0, back)
    beyond = df.filter(F.col(order) > anchor - 1 - back).orderBy(order).limit(back + size + 1)
    numbered = beyond.withColumn("_n", F.row_number().over(Window.orderBy(order)))
    flags = numbered.agg((F.max("_n") > back + size).alias("has_more"), F.min(order).alias("_first"))
    before = df.agg(F.min(order).alias("_least"))
    return numbered.filter(F.col("_n") <= back + size).drop("_n").crossJoin(F.broadcast(flags)).crossJoin(F.broadcast(before)).withColumn("has_previous", F.col("_least") < F.col("_first")).drop("_first", "_least")


def is_permutation(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key, whether two lists hold the same values as often each: keys, same."""
    both = old.select(*keys, value, F.lit(1).alias("_s")).unionByName(new.select(*keys, value, F.lit(-1).alias("_s")))
    sums = both.groupBy(*keys, value).agg(F.sum("_s").alias("_s"))
    return sums.groupBy(*keys).agg(F.every(F.col("_s") == 0).alias("same"))


def text_matches(headings: DataFrame, labels: DataFrame, keys: list[str], heading: str, label: str, order: str) -> DataFrame:
    """The first label, by ``order``, that each heading of the same page fits: equal, one the beginning of the other, or a heading of ten letters within the label.

    Letters count without case and closing punctuation; headings under three letters fit nothing. The pages' equi-join bounds what is compared.
    """
    form = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s.,;:!?]+$", "")
    a = headings.withColumn("_h", form(F.col(heading))).filter(F.char_length("_h") >= 3)
    b = labels.withColumn("_l", form(F.col(label)))
    fits = F.startswith("_l", "_h") | F.startswith("_h", "_l") | ((F.char_length("_h") >= 10) & F.contains("_l", F.col("_h")))
    best = a.join(b, keys).filter(fits).groupBy(*keys, heading).agg(F.min_by(label, order).alias(label))
    return best


def running_segments(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """The number of the run a row belongs to, null before the first one."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.nullif(F.sum(starts.cast("long")).over(window), F.lit(0)))


def snippet(text: Column, limit: int) -> Column:
    """The longest beginning of at most ``limit`` UTF-8 bytes that ends with a whole character."""
    start = F.substring(F.encode(text, "utf-8"), 1, limit)
    hexed = F.hex(start)
    # A character cut short is a lead byte with too few of its continuation bytes.
    short = F.regexp_replace(hexed, "^((?:[0-9A-F]{2})*?)(?:[CDEF][0-9A-F]|[EF][0-9A-F](?:[89AB][0-9A-F])|F[0-9A-F](?:[89AB][0-9A-F]){2})$", "$1")
    return F.decode(F.unhex(short), "utf-8")


def boxes(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The bounding box of each key's points: left, top, width, height."""
    found = points.groupBy(*keys).agg(F.min(x).alias("left"), F.min(y).alias("top"), F.max(x).alias("_x"), F.max(y).alias("_y"))
    return found.select(*keys, "left", "top", (F.col("_x") - F.col("left")).alias("width"), (F.col("_y") - F.col("top")).alias("height"))


def first_wins(df: DataFrame, keys: list[str], name: str, value: str, order: list[str]) -> DataFrame:
    """A map of attributes per key in which the first value of each name stays."""
    first = df.groupBy(*keys, name).agg(F.min_by(value, F.struct(*order)).alias("_v"))
    return first.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "_v")))).alias("attributes"))
