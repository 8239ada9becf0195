"""Texts to write: markdown files of nodes, their table of contents, and sitemaps.

Each gives rows of (file, n, value): the lines of files in order, so that a long file is never one value; ``write_files`` puts a
file's lines together by one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sentences as S

#: The frames of sitemaps.
XML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
URLSET, INDEX = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def file_name(position: Column, slug: Column) -> Column:
    return F.concat(F.when(F.char_length(position.cast("string")) < 3, F.lpad(position.cast("string"), 3, "0")).otherwise(position.cast("string")), F.lit("_"), slug, F.lit(".md"))


def marked(text: Column, anchors: Column) -> Column:
    """The text with ``{{ ref }}`` in front of each anchor (ref, char_offset); of anchors at one place the later one comes first, and one beyond the text stands at its end."""
    at = F.array_distinct(F.array_sort(F.transform(anchors, lambda a: F.least(a["char_offset"], F.char_length(text)))))
    parts = S.pieces(text, F.filter(at, lambda x: x > 0))
    spots = F.concat(F.array(F.lit(0)), F.filter(at, lambda x: x > 0))

    def marks(spot: Column) -> Column:
        mine = F.filter(anchors, lambda a: F.least(a["char_offset"], F.char_length(text)) == spot)
        return F.array_join(F.transform(F.reverse(mine), lambda a: F.concat(F.lit("{{ "), a["ref"], F.lit(" }} "))), "")

    return F.array_join(F.zip_with(parts, spots, lambda p, s: F.concat(marks(s), p)), "")


def markdown_lines(nodes: DataFrame, blocks: DataFrame, notes: DataFrame, page_key: str = "page") -> DataFrame:
    """file, n, value of the nodes' files.

    ``nodes``: node, position, slug, label, depth, page. ``blocks``: node, block, kind, text, page, anchors; a page mark stands where the page changes.
    ``notes``: node, note, marker, text.
    """
    name = file_name(F.col("position"), F.col("slug"))
    head = F.array(
        F.lit("---"), F.concat(F.lit("position: "), F.col("position").cast("string")), F.concat(F.lit('label: "'), F.replace("label", F.lit('"'), F.lit('\\"')), F.lit('"')),
        F.concat(F.lit("depth: "), F.col("depth").cast("string")), F.concat(F.lit(f"{page_key}: "), F.col("page").cast("string")), F.lit("---"), F.lit(""), F.concat(F.lit("# "), F.col("label")),
    )
    front = nodes.select("node", F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), head.alias("lines"))
    before = F.lag("page").over(Window.partitionBy("node").orderBy("block"))
    page = F.when(~before.eqNullSafe(F.col("page")), F.concat(F.lit("{{{ "), F.col("page").cast("string"), F.lit(" }}} "))).otherwise("")
    told = blocks.withColumn("line", F.concat(page, marked(F.col("text"), F.col("anchors"))))
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), F.col("line"))).otherwise(F.col("line"))
    body = told.select("node", F.lit(1).alias("part"), F.col("block").cast("long").alias("k"), F.array(F.lit(""), line).alias("lines"))
    first = F.row_number().over(Window.partitionBy("node").orderBy("note")) == 1
    note = F.concat(F.lit("[^"), F.col("marker"), F.lit("]: "), F.col("text"))
    foot = notes.select("node", F.lit(2).alias("part"), F.col("note").cast("long").alias("k"), F.when(first, F.array(F.lit(""), note)).otherwise(F.array(note)).alias("lines"))
    every = front.unionByName(body).unionByName(foot).select("node", "part", "k", F.posexplode("lines").alias("i", "value")).join(nodes.select("node", name.alias("file")), "node")
    return every.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("part", "k", "i")) - 1).alias("n"), "value")


def toc_lines(entries: DataFrame, book: str = "book", abbreviation: str = "p.") -> DataFrame:
    """book, n, value: a line an entry, indented by depth; those with a file are links. ``entries``: book, position, slug, label, depth, page, has_file."""
    label = F.when(F.col("has_file"), F.concat(F.lit("["), F.col("label"), F.lit("]("), file_name(F.col("position"), F.col("slug")), F.lit(")"))).otherwise(F.col("label"))
    value = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("depth") - 1, F.lit(0))), F.lit("- "), label, F.lit(f" — {abbreviation} "), F.col("page").cast("string"))
    return entries.select(book, (F.row_number().over(Window.partitionBy(book).orderBy("position")) - 1).alias("n"), value.alias("value"))


def _framed(rows: DataFrame, opens: str, closes: str) -> DataFrame:
    """Lines (file, k, value) in the frame of a sitemap."""
    files = rows.select("file").distinct()
    head = files.select("file", F.lit(-1).cast("long").alias("k"), F.posexplode(F.array(F.lit(XML_HEAD), F.lit(opens))).alias("i", "value"))
    foot = files.select("file", F.lit(2**62).alias("k"), F.lit(0).alias("i"), F.lit(closes).alias("value"))
    every = head.unionByName(foot).unionByName(rows.select("file", "k", F.lit(0).alias("i"), "value"))
    return every.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("k", "i", "value")) - 1).alias("n"), "value")


def _entry(tag: str, url: Column, changed: Column) -> Column:
    date = F.when(changed.isNotNull(), F.concat(F.lit("<lastmod>"), F.date_format(changed, "yyyy-MM-dd"), F.lit("</lastmod>"))).otherwise("")
    return F.concat(F.lit(f"  <{tag}><loc>"), url, F.lit("</loc>"), date, F.lit(f"</{tag}>"))


def book_sitemaps(books: DataFrame, nodes: DataFrame, origin: str) -> DataFrame:
    """file, n, value: a sitemap a book, itself first and then its nodes by ``sort_order``. ``books``: book, changed; ``nodes``: book, node, sort_order, changed."""
    place = F.concat(F.lit(f"{origin}/books/"), xml_escaped(F.col("book")))
    file = F.concat(F.lit("books/"), F.col("book"), F.lit(".xml"))
    own = books.select(file.alias("file"), F.lit(0).cast("long").alias("k"), _entry("url", place, F.col("changed")).alias("value"))
    inner = nodes.join(books.select("book"), "book", "left_semi")
    rows = inner.select(file.alias("file"), (F.col("sort_order").cast("long") + 1).alias("k"), _entry("url", F.concat(place, F.lit("/"), xml_escaped(F.col("node"))), F.col("changed")).alias("value"))
    return _framed(own.unionByName(rows), URLSET, "</urlset>")


def sitemap_index(books: DataFrame, origin: str) -> DataFrame:
    """The index: the site's own sitemap and one for each book. Books are few: they are lines of one file."""
    site = books.sparkSession.range(1).select(F.lit("").alias("_b"), F.lit(f"  <sitemap><loc>{origin}/sitemaps/site.xml</loc></sitemap>").alias("value"))
    each = books.select(F.col("book").alias("_b"), _entry("sitemap", F.concat(F.lit(f"{origin}/sitemaps/books/"), xml_escaped(F.col("book")), F.lit(".xml")), F.col("changed")).alias("value"))
    rows = site.unionByName(each).select(F.lit("index.xml").alias("file"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_b")).cast("long").alias("k"), "value")
    return _framed(rows, INDEX, "</sitemapindex>")


def write_files(lines: DataFrame, path: str, file: str = "file") -> None:
    """A folder a file (``file=<name>``) with its lines in order in one part."""
    lines.repartition(file).sortWithinPartitions(file, "n").select(file, "value").write.mode("overwrite").partitionBy(file).text(path)
