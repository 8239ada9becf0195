"""Curated markdown: front matter, and the line grammars of prose, poetry and drama as windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str) -> DataFrame:
    """name, content of the markdown files of a folder, but for its table of contents."""
    read = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return read.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content")).filter("name <> '000_toc.md'")


def front_matter(df: DataFrame, content: str = "content") -> DataFrame:
    """Add position, label, depth and body; a file without a fenced header has nulls and is all body."""
    head = F.regexp_extract(content, r"\A---\n([\s\S]*?)\n---\n?", 1)
    fenced = F.col(content).rlike(r"\A---\n[\s\S]*?\n---")

    def value(key: str) -> Column:
        return F.nullif(F.regexp_extract(head, rf"(?m)^{key}:\s*(.*?)\s*$", 1), F.lit(""))

    label = F.replace(F.regexp_replace(value("label"), '^"|"$', ""), F.lit('\\"'), F.lit('"'))
    body = F.when(fenced, F.regexp_replace(content, r"\A---\n[\s\S]*?\n---\n?", "")).otherwise(F.col(content))
    return df.select("*", value("position").try_cast("int").alias("position"), label.alias("label"), value("depth").try_cast("int").alias("depth"), body.alias("body"))


def _lines(df: DataFrame, key: str, body: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(body, "\n")).alias("n", "line"))


def _merged(lines: DataFrame, key: str, kind: Column, joins: Column, text: Column, separator: str = " ") -> DataFrame:
    """Consecutive lines of one kind that join become one block; lines of kind null only separate."""
    order = Window.partitionBy(key).orderBy("n")
    tagged = lines.withColumn("kind", kind).withColumn("_text", text)
    opens = F.coalesce(F.lag("kind").over(order) != F.col("kind"), F.lit(True)) | F.lag("kind").over(order).isNull() | ~joins
    numbered = tagged.withColumn("_o", opens).withColumn("_b", F.sum(F.col("_o").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = numbered.filter("kind is not null").groupBy(key, "_b", "kind").agg(F.min("n").alias("first_line"), F.array_sort(F.collect_list(F.struct("n", "_text"))).alias("_l"))
    out = blocks.select(key, "kind", "first_line", F.array_join(F.transform("_l", lambda x: x["_text"]), separator).alias("text"))
    return out.withColumn("position", (F.row_number().over(Window.partitionBy(key).orderBy("first_line")) - 1).cast("int")).drop("first_line")


def prose(df: DataFrame, key: str = "name", body: str = "body") -> DataFrame:
    """Blocks of prose: footnotes, separators, headings and paragraphs, whose lines are joined by spaces ('+ ' opens a run)."""
    line = F.col("line")
    kind = F.when(F.trim(line) == "", None).when(line.rlike(r"^\[\^[^\]]+\]:"), "footnote").when(F.trim(line).isin("---", "***"), "separator").when(line.startswith("## "), "heading").otherwise("paragraph")
    return _merged(_lines(df, key, body), key, kind, kind == "paragraph", F.trim(F.regexp_replace(line, r"^(## |\+ )", "")))


def poetry(df: DataFrame, key: str = "name", body: str = "body") -> DataFrame:
    """Headings and stanzas; a stanza keeps its lines."""
    line = F.col("line")
    kind = F.when(F.trim(line) == "", None).when(line.startswith("## "), "heading").otherwise("verse")
    return _merged(_lines(df, key, body), key, kind, kind == "verse", F.rtrim(F.regexp_replace(line, "^## ", "")), "\n")


def drama(df: DataFrame, key: str = "name", body: str = "body") -> DataFrame:
    """Headings, stage directions, speakers, verse, lists and prose, in this order of precedence; like lines merge."""
    line = F.col("line")
    kind = F.when(F.trim(line) == "", None).when(line.startswith("## "), "heading").when(line.startswith("@stage"), "stage").when(line.startswith("@ "), "speaker").when(line.startswith("*("), "stage").when(line.startswith("| "), "verse").when(line.startswith("- "), "list").otherwise("prose")
    joins = kind.isin("verse", "list", "prose")
    return _merged(_lines(df, key, body), key, kind, joins, F.trim(F.regexp_replace(line, r"^(## |@stage ?|@ |\| |- )", "")), "\n")


_MARK = r"\{\{\{[^{}]+\}\}\} ?|\{\{[^{}]+\}\} ?"


def markers(text: Column) -> Column:
    """struct(text, markers: array of (system, ref_value, char_offset)): markers lifted out, offsets in what is left."""
    found = F.regexp_extract_all(text, F.lit(rf"({_MARK})"), F.lit(1))
    between = F.split(text, _MARK, -1)
    items = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, b: F.struct(F.char_length(a).alias("gap"), b.alias("m")))
    empty = F.array().cast("array<struct<system:string,ref_value:string,char_offset:int>>")

    def step(acc, x):
        at = acc["at"] + x["gap"]
        system = F.when(x["m"].startswith("{{{"), "block").otherwise("inline")
        one = F.struct(system.alias("system"), F.trim(F.regexp_replace(x["m"], r"[{}]", "")).alias("ref_value"), at.alias("char_offset"))
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    lifted = F.aggregate(items, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.struct(F.regexp_replace(text, _MARK, "").alias("text"), lifted.alias("markers"))


def owner(starts: Column, offset: Column) -> Column:
    """The last sentence that starts at or before an offset, from ascending starts; 0 at least."""
    return F.greatest(F.size(F.filter(starts, lambda s: s <= offset)) - 1, F.lit(0))
