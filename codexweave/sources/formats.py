"""Readers of verse JSON, struct JSON, XHTML, and tables in TSV; writers of reports and snapshots."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSES = "verses array<struct<chapter:int,verse:int,text:string>>"


def verse_json(spark: SparkSession, path: str) -> DataFrame:
    """translation, book, chapter, verse, text from <translation>/<book>/<chapter>.json."""
    read = spark.read.schema(VERSES).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    keyed = read.select(F.get(parts, F.size(parts) - 3).alias("translation"), F.get(parts, F.size(parts) - 2).alias("book"), F.explode("verses").alias("v"))
    return keyed.select("translation", "book", "v.chapter", "v.verse", F.trim("v.text").alias("text"))


def struct_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Whole-file JSON of nested nodes, with a given schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def checked_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A TSV with a header; a row that doesn't fit the schema refuses the whole read."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "FAILFAST").csv(path)


class _Blocks(HTMLParser):
    """Block elements of a page in order: (kind, text, html, page reference); only i b sup sub stay in html."""

    KINDS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "p": "paragraph", "table": "paragraph"}
    SKIPPED = {"script", "style", "head", "nav"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.tag, self.text, self.html, self.page, self.skip, self.link = [], None, "", "", None, 0, False

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in self.SKIPPED:
            self.skip += 1
        elif self.skip:
            return
        elif tag == "div" and "emptyLine" in (attrs.get("class") or ""):
            self.out.append(("separator", "", "", None))
        elif tag in self.KINDS and self.tag is None:
            self.tag, self.text, self.html, self.page = tag, "", "", None
        elif tag == "a" and "page" in (attrs.get("class") or "").split():
            self.link = True
        elif tag in ("i", "b", "sup", "sub") and self.tag:
            self.html += f"<{tag}>"

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(self.skip - 1, 0)
        elif self.skip:
            return
        elif tag == self.tag:
            text = re.sub(r"\s+", " ", self.text.replace("\xa0", " ")).strip()
            if text:
                self.out.append((self.KINDS[tag], text, re.sub(r"\s+", " ", self.html).strip(), self.page))
            self.tag = None
        elif tag == "a":
            self.link = False
        elif tag in ("i", "b", "sup", "sub") and self.tag:
            self.html += f"</{tag}>"

    def handle_data(self, data):
        if self.skip or self.tag is None:
            return
        if self.link:
            self.page = re.sub(r"[\[\]\s]", "", data) or self.page
            return
        self.text += data
        self.html += data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def html_blocks(html: Column) -> Column:
    """array of (kind, text, html, page_ref)."""

    @F.pandas_udf("array<struct<kind:string,text:string,html:string,page_ref:string>>")
    def run(pages: pd.Series) -> pd.Series:
        def blocks(page: str) -> list[dict]:
            parser = _Blocks()
            parser.feed(page or "")
            parser.close()
            return [dict(zip(("kind", "text", "html", "page_ref"), b)) for b in parser.out]

        return pages.map(blocks)

    return run(html)


def epub_sections(spark: SparkSession, path: str) -> DataFrame:
    """source, member, blocks of the XHTML members of EPUB files, one row a member."""
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            rows = []
            for source, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    rows += [(source, n, book.read(n).decode("utf-8", "replace")) for n in sorted(book.namelist()) if n.endswith((".xhtml", ".html"))]
            yield pd.DataFrame(rows, columns=["source", "member", "html"])

    return books.mapInPandas(run, "source string, member string, html string").select("source", "member", html_blocks(F.col("html")).alias("blocks"))


def nav_points(xml: Column) -> Column:
    """array of (depth, label, file, fragment) of an NCX table of contents, depth first."""

    @F.pandas_udf("array<struct<depth:int,label:string,file:string,fragment:string>>")
    def run(documents: pd.Series) -> pd.Series:
        def walk(node, depth: int, out: list) -> list:
            for point in node.findall("{*}navPoint"):
                file, _, fragment = point.find("{*}content").get("src", "").partition("#")
                out.append({"depth": depth, "label": "".join(point.find("{*}navLabel").itertext()).strip(), "file": file, "fragment": fragment or None})
                walk(point, depth + 1, out)
            return out

        return documents.map(lambda x: walk(ElementTree.fromstring(x).find("{*}navMap"), 0, []) if x else [])

    return run(xml)


def ocr_lines(pages: DataFrame, page: str, lines: str) -> DataFrame:
    """Lines (text, x, y in pixels) with paragraph numbers: a new one after a gap of 1.5 times the page's median spacing or 30 pixels right of its median edge."""
    from pyspark.sql import Window

    each = pages.select(page, F.explode(lines).alias("l")).select(page, "l.*")
    order = Window.partitionBy(page).orderBy("y", "x")
    spaced = each.withColumn("gap", F.col("y") - F.lag("y").over(order))
    middle = spaced.groupBy(page).agg(F.median("gap").alias("m"), F.median("x").alias("e"))
    opens = F.coalesce((F.col("gap") > 1.5 * F.col("m")) | (F.col("x") > F.col("e") + 30), F.lit(True))
    return spaced.join(middle, page).withColumn("paragraph", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).select(page, "paragraph", "text", "x", "y")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_struct(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_editions(df: DataFrame, path: str, by: str = "book_id") -> None:
    """Normalised rows by book; only the books in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def artefact_hash(spark: SparkSession, path: str) -> DataFrame:
    """One digest of a folder: of its files' digests and names with their folders, in order of name; renaming a file changes it."""
    base = re.escape(re.sub(r"^\w+:/*(?=/)", "", path).rstrip("/")) + "/"
    name = F.regexp_replace("path", f"^.*?{base}", "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(name.alias("name"), F.sha2("content", 256).alias("h"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda x: F.concat(x["h"], F.lit("  "), x["name"], F.lit("\n")))
    return files.agg(F.substring(F.sha2(F.array_join(lines, ""), 256), 1, 12).alias("artefact"))
