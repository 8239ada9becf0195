"""Scanned pages: raw recognition responses to lines, lines to zones, elements and notes, and elements to text across pages.

Everything is a column expression or a window over the lines of a page; only what runs from page to page (torn words, numbers of notes) has
a window over a book's elements. A response without text, pages, lines, anchors or boxes gives no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sentences as S

#: Indices come as numbers or as strings; both are read as strings.
RESPONSE = (
    "struct<text:string,pages:array<struct<dimension:struct<width:double,height:double>,lines:array<struct<layout:struct<"
    "textAnchor:struct<textSegments:array<struct<startIndex:string,endIndex:string>>>,boundingPoly:struct<normalizedVertices:array<struct<x:double,y:double>>>>>>>>>"
)
#: Page size where none is given, zones in pixels, spacing that opens a paragraph.
WIDTH, HEIGHT, HEADER_BELOW, NOTES_FROM, NOTES_GAP, SPACING, INDENT = 1575.0, 2434.0, 220.0, 0.65, 30.0, 1.5, 30.0
_SUPERSCRIPT, _DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
_NOTE = r"(?:^|\s)(?:[0-9⁰¹²³⁴⁵⁶⁷⁸⁹]{1,2}|\*{1,4})\s?\)"


def lines(pages: DataFrame, response: str = "response") -> DataFrame:
    """The columns of ``pages`` but for the response, and n, text, x, y, width, height of each line of its first page, in pixels."""
    kept = [c for c in pages.columns if c != response]
    read = pages.select(*kept, F.from_json(response, RESPONSE).alias("r")).withColumn("p", F.get("r.pages", F.lit(0)))
    each = read.select(*kept, "r", "p", F.posexplode("p.lines").alias("n", "l"))
    segments, vertices = F.col("l.layout.textAnchor.textSegments"), F.col("l.layout.boundingPoly.normalizedVertices")

    def index(x: Column) -> Column:
        return F.coalesce(x.try_cast("int"), F.lit(0))

    cut = F.transform(segments, lambda s: F.substring(F.col("r.text"), index(s["startIndex"]) + 1, F.greatest(index(s["endIndex"]) - index(s["startIndex"]), F.lit(0))))
    size = {"x": F.coalesce("p.dimension.width", F.lit(WIDTH)), "y": F.coalesce("p.dimension.height", F.lit(HEIGHT))}
    boxed = each.withColumn("text", F.regexp_replace(F.array_join(cut, ""), r"\n+\z", ""))

    def along(axis: str) -> Column:
        return F.transform(vertices, lambda v: F.coalesce(v[axis], F.lit(0.0)) * size[axis])

    boxed = boxed.withColumn("_x", along("x")).withColumn("_y", along("y"))
    boxed = boxed.filter((S.trimmed(F.col("text")) != "") & (F.size("_x") > 0))
    low, high = ({a: f(f"_{a}") for a in "xy"} for f in (F.array_min, F.array_max))
    return boxed.select(*kept, "n", "text", low["x"].alias("x"), low["y"].alias("y"), (high["x"] - low["x"]).alias("width"), (high["y"] - low["y"]).alias("height"))


def without_line_numbers(found: DataFrame, page: str = "page") -> DataFrame:
    """Lines with ``line_number``: a multiple of 5 up to 40 in the margin, on the left of even pages and the right of odd ones; lines of nothing else go."""

    def valid(x: Column) -> Column:
        return F.coalesce(x.try_cast("int").isin(*range(5, 41, 5)), F.lit(False))

    at_end = F.col(page) % 2 == 1
    head, tail = r"^(\d{1,2})\s+", r"\s+(\d{1,2})\s*$"
    number = F.when(at_end, F.regexp_extract("text", tail, 1)).otherwise(F.regexp_extract("text", head, 1))
    bare = F.when(at_end, F.regexp_replace("text", tail, "")).otherwise(F.regexp_replace("text", head, ""))
    alone = F.trim("text").rlike(r"^\d{1,2}$") & valid(F.trim("text"))
    rows = found.filter(~alone).withColumn("line_number", F.when(valid(number), number.try_cast("int")))
    return rows.withColumn("text", F.when(F.col("line_number").isNotNull(), bare).otherwise(F.col("text")))


def zoned(found: DataFrame, page: str = "page", front_matter: int = 0, height: float = HEIGHT) -> DataFrame:
    """Lines with ``zone``: header, body or notes. Notes begin at the first wide gap in the lower part of a page behind which one of five lines opens with a note's mark."""
    front = F.col(page) <= front_matter
    rows = found.withColumn("zone", F.when((F.col("y") < HEADER_BELOW) & ~front, "header").otherwise("body"))
    order = Window.partitionBy(page, "zone").orderBy("y", "x", "n")
    bottom = F.lag(F.col("y") + F.col("height")).over(order)
    ahead = F.array_join(F.collect_list("text").over(order.rowsBetween(0, 4)), " ")
    gap = (F.col("zone") == "body") & ~front & (F.col("y") > NOTES_FROM * height) & (F.col("y") - bottom >= NOTES_GAP) & ahead.rlike(_NOTE)
    told = rows.withColumn("_cut", F.when(gap, F.col("y")))
    first = F.min("_cut").over(Window.partitionBy(page))
    return told.withColumn("zone", F.when((F.col("zone") == "body") & (F.col("y") >= first), "notes").otherwise(F.col("zone"))).drop("_cut")


def columned(found: DataFrame, page: str = "page", gutter: float = 40.0) -> DataFrame:
    """Lines with ``column`` and ``place``: columns are separate where no line of the zone reaches over a gap of ``gutter`` pixels; read column by column, then by y and x."""
    across = Window.partitionBy(page, "zone").orderBy("x", "n")
    reach = F.max(F.col("x") + F.col("width")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("x") - reach >= gutter).cast("int"), F.lit(0))
    rows = found.withColumn("_o", opens).withColumn("column", F.sum("_o").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    zone = F.when(F.col("zone") == "header", 0).when(F.col("zone") == "body", 1).otherwise(2)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(zone, "column", "y", "x", "n")) - 1).drop("_o")


def stitched(texts: Column) -> Column:
    """Lines as one text: a line that ends with a hyphen is joined to the next without it, any other by a space; blank lines are none."""
    kept = F.filter(F.transform(texts, S.trimmed), lambda t: t != "")
    joined = F.aggregate(kept, F.lit(""), lambda acc, t: F.when(acc == "", t).when(acc.endswith("-"), F.concat(F.substring(acc, F.lit(1), F.char_length(acc) - 1), t)).otherwise(F.concat(acc, F.lit(" "), t)))
    return joined


def is_heading(text: Column, n: Column) -> Column:
    """A short element of one or two lines that opens with a capital (behind numbers) and does not end in a comma or colon."""
    clean = F.regexp_replace(text, "^[0-9. ]+", "")
    return (F.octet_length(text) < 80) & (n <= 2) & clean.rlike(r"^\p{Lu}") & ~F.rtrim(text).rlike("[,;:]$")


def elements(found: DataFrame, page: str = "page") -> DataFrame:
    """page, element, kind, text, lines, markers of a page's body: a paragraph opens at a gap of 1.5 times the median spacing or 30 pixels right of the median edge."""
    body = found.filter("zone = 'body'")
    order = Window.partitionBy(page).orderBy("y", "x", "n")
    spaced = body.withColumn("_s", F.col("y") - F.lag("y").over(order))
    middle = spaced.groupBy(page).agg(F.median(F.when(F.col("_s") > 0, F.col("_s"))).alias("_m"), F.median("x").alias("_e"))
    opens = F.col("_m").isNotNull() & F.col("_s").isNotNull() & ((F.col("_s") > SPACING * F.col("_m")) | (F.col("x") > F.col("_e") + INDENT))
    grouped = spaced.join(middle, page).withColumn("element", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lists = grouped.groupBy(page, "element").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "n", "text"))), lambda s: s["text"]).alias("lines"))
    text = F.array_join("lines", "\n")
    marks = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9⁰¹²³⁴⁵⁶⁷⁸⁹]{1,2}|\*{1,4})\s?\)"), F.lit(1)), lambda m: F.translate(m, _SUPERSCRIPT, _DIGITS))
    return lists.select(page, "element", F.when(is_heading(text, F.size("lines")), "heading").otherwise("paragraph").alias("kind"), text.alias("text"), "lines", marks.alias("markers"))


def notes(found: DataFrame, page: str = "page") -> DataFrame:
    """page, place, marker, text of the notes of each page: its notes' lines as one text, cut at marks; superscripts count as digits."""
    rows = found.filter("zone = 'notes'").groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "n", "text"))), lambda s: s["text"]), "\n").alias("t"))
    t = F.translate("t", _SUPERSCRIPT, _DIGITS)
    mark = r"(?:^|(?<=\s))([0-9]{1,2}|\*{1,4})\s?\)"
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(mark), F.lit(1)).alias("marker"), F.slice(F.split(t, mark, -1), F.lit(2), F.size(F.split(t, mark, -1))).alias("text"))
    each = rows.select(page, F.posexplode(pairs).alias("place", "p")).select(page, "place", "p.marker", F.regexp_replace(F.trim(F.regexp_replace("p.text", r"^\s+|\s+$", "")), "\n", " ").alias("text"))
    return each.filter("text <> ''")


def remapped(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Notes with ``mark``: within a section stars grow one by one and numbers run on, whatever each page called them."""
    star, digit = F.col("marker").rlike(r"^\*+$"), F.col("marker").rlike("^[0-9]+$")
    kind = F.when(star, "star").when(digit, "digit").otherwise("other")
    count = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order))
    return found.withColumn("mark", F.when(star, F.repeat(F.lit("*"), count)).when(digit, count.cast("string")).otherwise(F.col("marker")))


def referred(text: Column, marks: Column) -> Column:
    """References such as ``*)``, ``1)`` or ``¹)`` as ``[^mark]`` by a map of this page's markers; others stay."""

    def change(m: Column, _: Column) -> Column:
        mark = F.try_element_at(marks, F.translate(F.substring(m, F.lit(1), F.char_length(m) - 1), _SUPERSCRIPT, _DIGITS))
        return F.coalesce(F.concat(F.lit("[^"), mark, F.lit("]")), m)

    return S.each_match(text, r"(?:[0-9⁰¹²³⁴⁵⁶⁷⁸⁹]{1,2}|\*{1,4})\)", change)


def across_pages(found: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """Elements with their text stitched; where the last element of a page ends with a hyphen the first word of the next page is moved to it."""
    order = Window.partitionBy(*keys).orderBy(page, "element")
    rows = found.withColumn("whole", stitched(F.col("lines")))
    following, torn = F.lead("whole").over(order), F.col("whole").endswith("-")
    next_page = F.lead(page).over(order) > F.col(page)
    first = F.regexp_extract(F.coalesce(following, F.lit("")), r"^(\S+)", 1)
    takes = torn & next_page & (first != "")
    told = rows.withColumn("_takes", F.coalesce(takes, F.lit(False))).withColumn("_first", first)
    gave = F.coalesce(F.lag("_takes").over(order), F.lit(False))
    kept = F.when(gave, F.regexp_replace("whole", r"^\S+\s*", "")).otherwise(F.col("whole"))
    text = F.when(F.col("_takes"), F.concat(F.substring(kept, F.lit(1), F.char_length(kept) - 1), F.col("_first"))).otherwise(kept)
    return told.withColumn("stitched", text).drop("_takes", "_first", "whole")


def cleaned(text: Column) -> Column:
    """Stray backslashes before brackets go, and straight quotes that close no „."""
    plain = F.replace(F.replace(text, F.lit("\\')"), F.lit(")")), F.lit('\\")'), F.lit(")"))
    return F.regexp_replace(plain, '(„[^"]*")|"', "$1")


def sections(found: DataFrame, entries: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """Elements with ``section``: the last entry of the table of contents whose page is at or before theirs; entries before any page count from the start."""
    from ..operators import ranges

    placed = entries.select(*keys, F.col(page), F.col("entry"))
    first = entries.groupBy(*keys).agg(F.min("entry").alias("_first"))
    asof = ranges.asof_backward(found, placed, keys, [page], "entry", "section")
    return asof.join(first, keys, "left").withColumn("section", F.coalesce("section", "_first")).drop("_first")
