"""EPUB books: metadata, the tree of contents, and sections cut where its anchors stand.

A book's members are read inside tasks, a row a member; their XML becomes events (``tei.events``), and the rest are windows and joins over
these. An element right under the body is one block. Which entry of the contents a block belongs to is an as-of join: the last entry
whose anchor stands at or before it. Notes begin at their heading and last to the end of the section.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sentences as S
from ..operators.lineage import dealt
from . import tei

#: The class and first word of the heading over notes; tags that a block's HTML keeps.
NOTES_CLASS, NOTES_WORD, KEPT = "fn", "Fußnote", ["i", "b", "sup", "sub"]
_META = "metadata struct<title:array<string>,creator:array<struct<_VALUE:string,_role:string>>,language:array<string>,publisher:array<string>,date:array<string>>"


def members(spark: SparkSession, path: str) -> DataFrame:
    """book, member, content of the text members of EPUB files; a member's folder is dropped, as the contents name members without it."""
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    names = [n for n in sorted(book.namelist()) if n.endswith((".opf", ".ncx", ".xhtml", ".html"))]
                    for n in names:
                        yield pd.DataFrame([(source, n.rpartition("/")[2], book.read(n).decode("utf-8", "replace"))], columns=["book", "member", "content"])

    return books.mapInPandas(run, "book string, member string, content string")


def metadata(opf: Column) -> Column:
    """struct(title, author, language, publisher, date) of a package document; the author is the creator of that role, else the first; what is missing is empty."""
    m = F.from_xml(opf, _META, {"ignoreNamespace": "true"})["metadata"]
    authors = F.filter(m["creator"], lambda c: c["_role"] == "aut")
    author = F.coalesce(F.get(authors, F.lit(0))["_VALUE"], F.get(m["creator"], F.lit(0))["_VALUE"], F.lit(""))
    first = {k: F.coalesce(F.get(m[k], F.lit(0)), F.lit("")).alias(k) for k in ("title", "language", "publisher", "date")}
    return F.struct(first["title"], author.alias("author"), first["language"], first["publisher"], first["date"])


def nav_points(found: DataFrame) -> DataFrame:
    """file, place (depth first), id, play_order, depth, label, member, fragment, parent of a table of contents given as events."""
    point = F.try_element_at(F.filter("path", lambda x: x["name"] == "navPoint"), F.lit(-1))["id"]
    inside = found.withColumn("point", point).filter("point IS NOT NULL")
    label = F.when((F.col("kind") == "text") & F.exists("path", lambda x: x["name"] == "navLabel"), F.struct("n", "text"))
    src = F.max(F.when((F.col("kind") == "open") & (F.col("name") == "content"), F.col("attrs")["src"]))
    depth, parent = F.size(F.filter("path", lambda x: x["name"] == "navPoint")), F.get(F.filter("path", lambda x: x["name"] == "navPoint"), F.size(F.filter("path", lambda x: x["name"] == "navPoint")) - 2)["id"]
    own = (F.col("kind") == "open") & (F.col("name") == "navPoint")
    rows = inside.groupBy("file", "point").agg(
        F.max(F.when(own, F.struct(F.col("attrs")["id"].alias("id"), F.col("attrs")["playOrder"].try_cast("int").alias("play_order"), depth.alias("depth"), parent.alias("parent")))).alias("p"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(label)), lambda x: x["text"]), "")).alias("label"), src.alias("src"),
    )
    ids = rows.select("file", F.col("point").alias("_parent"), F.col("p.id").alias("parent"))
    told = rows.select("file", "point", "p.id", "p.play_order", "p.depth", F.col("p.parent").alias("_parent"), "label", F.substring_index("src", "#", 1).alias("member"), F.nullif(F.regexp_extract("src", "#(.*)$", 1), F.lit("")).alias("fragment"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("point")) - 1
    return told.withColumn("place", place).join(ids, ["file", "_parent"], "left").drop("_parent", "point")


def body_elements(found: DataFrame) -> DataFrame:
    """file, child (place under the body), tag, class, ids (its own and those within), text, html, page_ref of the elements right under the body. Links to pages are in neither layer.

    A link opens within its element, so an element's pieces know their links by themselves, without a join of all events. What follows is dealt by file.
    """
    depth = F.array_position(F.transform("path", lambda x: x["name"]), "body").cast("int")
    inside = found.withColumn("child", F.get("path", depth)["id"]).filter("child IS NOT NULL")
    link = F.try_element_at(F.filter("path", lambda x: (x["name"] == "a") & (x["id"] >= F.col("child"))), F.lit(-1))["id"]
    is_open, is_text = F.col("kind") == "open", F.col("kind") == "text"
    tag = F.col("name").isin(KEPT) & (F.col("n") != F.col("child"))
    html = F.when(is_text, F.col("text")).when(tag, F.concat(F.when(is_open, "<").otherwise("</"), F.col("name"), F.lit(">")))
    piece = F.when(html.isNotNull(), F.struct("n", "link", is_text.alias("is_text"), html.alias("v")))
    own = is_open & (F.col("n") == F.col("child"))
    page = is_open & (F.col("name") == "a") & (F.col("attrs")["class"] == "page")
    rows = inside.withColumn("link", link).groupBy("file", "child").agg(
        F.max(F.when(own, F.struct("name", F.col("attrs")["class"].alias("class"), F.col("attrs")["id"].alias("id")))).alias("own"), F.collect_set(F.when(is_open, F.col("attrs")["id"])).alias("ids"),
        F.array_sort(F.collect_list(piece)).alias("pieces"), F.collect_set(F.when(page, F.col("n"))).alias("pages"),
    )

    def joined(test) -> Column:
        return F.array_join(F.transform(F.filter("pieces", test), lambda x: x["v"]), "")

    bare = lambda x: ~F.coalesce(F.array_contains("pages", x["link"]), F.lit(False))
    first = F.array_min("pages")
    told = rows.select("file", "child", "own", "ids", S.trimmed(joined(lambda x: bare(x) & x["is_text"])).alias("text"), S.trimmed(joined(bare)).alias("html"), joined(lambda x: x["is_text"] & (x["link"] == first)).alias("ref"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("child")) - 1
    return dealt(told, "file").select("file", number.alias("child"), F.col("own.name").alias("tag"), F.col("own.class").alias("class"), F.col("own.id").alias("id"), "ids", "text", "html", F.nullif(F.regexp_extract(F.trim("ref"), r"^\[(.*)\]$", 1), F.lit("")).alias("page_ref"))


def _kind() -> Column:
    tag, text = F.col("tag"), F.col("text")
    return (
        F.when((tag == "p") & F.col("id").isNotNull() & (text == ""), None)
        .when((tag == "div") & (F.col("class") == "emptyLine"), "separator")
        .when(tag.rlike("^h[1-5]$") & (text != ""), "heading")
        .when((tag == "p") & ~F.coalesce(F.col("class") == NOTES_CLASS, F.lit(False)) & (text != ""), "paragraph")
        .when((tag == "table") & (text != ""), "paragraph")
    )


def sections(elements: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id (of the entry of the contents), position, kind, text, html, page_ref. ``points``: keys, id, play_order, fragment; keys name a member of a book.

    An entry without a fragment has the whole member if it is the only one, else the anchor ``an`` and the member's name; an anchor that is not there is the
    beginning. What stands before the first anchor belongs to none.
    """
    member = F.col(keys[-1])
    alone = F.count("*").over(Window.partitionBy(*keys)) == 1
    anchored = points.select(*keys, "id", "play_order", F.when(F.col("fragment").isNotNull(), F.col("fragment")).when(~alone, F.concat(F.lit("an"), F.regexp_replace(member, r"\.html$", ""))).alias("anchor"))
    marks = elements.select(*keys, "child", F.explode("ids").alias("anchor")).groupBy(*keys, "anchor").agg(F.min("child").alias("at"))
    starts = anchored.join(marks, [*keys, "anchor"], "left").groupBy(*keys, F.coalesce("at", F.lit(0)).alias("child")).agg(F.max(F.struct("play_order", "id")).alias("entry"))
    every = elements.join(starts, [*keys, "child"], "left")
    order = Window.partitionBy(*keys).orderBy("child").rowsBetween(Window.unboundedPreceding, 0)
    owned = every.withColumn("entry", F.last("entry", ignorenulls=True).over(order)).filter("entry IS NOT NULL")
    heading = (F.col("tag") == "p") & (F.col("class") == NOTES_CLASS) & F.col("text").startswith(NOTES_WORD)
    inner = Window.partitionBy(*keys, "entry").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)
    latched = owned.withColumn("is_heading", F.coalesce(heading, F.lit(False))).withColumn("latched", F.coalesce(F.max("is_heading").over(inner), F.lit(False)))
    note = F.when((F.col("tag") == "p") & (F.col("text") != ""), "footnote")
    rows = latched.filter("NOT is_heading").withColumn("kind", F.when(F.col("latched"), note).otherwise(_kind())).filter("kind IS NOT NULL")
    position = F.row_number().over(Window.partitionBy(*keys, "entry").orderBy("child")) - 1
    bare = F.col("kind") == "separator"
    return rows.select(*keys, F.col("entry.id").alias("id"), position.alias("position"), "kind", F.when(bare, "").otherwise(F.col("text")).alias("text"), F.when(bare, "").otherwise(F.col("html")).alias("html"), F.when(F.col("kind").isin("paragraph", "footnote") & (F.col("tag") == "p"), F.col("page_ref")).alias("page_ref"))


def book(found: DataFrame) -> DataFrame:
    """From members (book, member, content): the blocks of all sections with their place in the contents, depth, label and paragraph number through the book."""
    contents = tei.events(found.filter("member LIKE '%.ncx'"), "book", "content")
    points = nav_points(contents).withColumnRenamed("file", "book")
    texts = found.filter("member LIKE '%.html' OR member LIKE '%.xhtml'").withColumn("key", F.to_json(F.struct("book", "member")))
    elements = body_elements(tei.events(texts, "key", "content"))
    names = F.from_json("file", "book string, member string")
    elements = elements.withColumn("book", names["book"]).withColumn("member", names["member"]).drop("file")
    cut = sections(elements, points, ["book", "member"])
    rows = cut.join(points.select("book", "member", "id", "place", "depth", "label"), ["book", "member", "id"])
    number = F.row_number().over(Window.partitionBy("book", "kind").orderBy("place", "position"))
    return rows.withColumn("paragraph_number", F.when(F.col("kind") == "paragraph", number))
