"""From curated prose markdown to numbered sentences with notes, page marks and runs.

``blocks`` reads each body by itself; numbers then run through a book by windows over its blocks (a row a block, none a sentence),
footnote references meet their numbers by a join on (book, file), and texts are rendered, cut and marked as column expressions. A book's
blocks are ordered by file and position in one window partition: as large as one book's list of blocks without their texts, since
numbers are joined back to the texts by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sentences as S
from ..functions import text as X
from ..operators.lineage import staged
from .blocks import blocks

_TOKEN = r"\{\{\$m\s+`[^`]*`\}\}"
_REFERENCE = r"\[\^[^\]]+\]"
_MARK = r"\{\{\{?\s*[^}]+?\s*\}?\}\} ?"
_ANCHOR, _MARKERS = "struct<kind:string,value:string,char_offset:int>", "array<struct<kind:string,value:string,char_offset:int>>"


def md_to_plain(text: Column) -> Column:
    """The text of the prose dialect: footnote references go, emphasis keeps its words."""
    out = F.regexp_replace(text, _REFERENCE, "")
    for mark in (r"\*\*\*([^*]+)\*\*\*", r"\*\*([^*]+)\*\*", "_([^_]+)_", "<i>([^<]*)</i>"):
        out = F.regexp_replace(out, mark, "$1")
    return out


def md_to_html(text: Column) -> Column:
    """The HTML of the prose dialect; stars within a reference stand aside while emphasis is read."""
    out = S.each_match(text, _REFERENCE, lambda m, _: F.concat(F.lit("<sup>"), F.replace(F.substring(m, F.lit(3), F.char_length(m) - 3), F.lit("*"), F.lit("￼")), F.lit("</sup>")))
    antiqua = '<span class="antiqua">$1</span>'
    for mark, tag in ((r"\*\*\*([^*]+)\*\*\*", '<span class="sperrdruck">$1</span>'), (r"\*\*([^*]+)\*\*", "<b>$1</b>"), ("_([^_]+)_", antiqua), ("<i>([^<]*)</i>", antiqua)):
        out = F.regexp_replace(out, mark, tag)
    return F.replace(out, F.lit("￼"), F.lit("*"))


def lift(text: Column) -> Column:
    """struct(text, markers): marks out of a rendered text, each with one space behind it; offsets in what is left."""
    return S.bound(text, _lifted)


def _lifted(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(_MARK), F.lit(0))
    items = F.zip_with(F.slice(F.split(text, _MARK, -1), F.lit(1), F.size(found)), found, lambda a, b: F.struct(F.char_length(a).alias("gap"), b.alias("m")))

    def one(m: Column, at: Column) -> Column:
        margin, page = F.regexp_extract(m, r"\{\{\$m (\d+)\}\}", 1), F.regexp_extract(m, r"\{\{\{\s*([0-9]+[a-z]?|[IVXLCDM]+)\s*\}\}\}", 1)
        kind = F.when(margin != "", "margin").when(page != "", "page").otherwise("edition")
        value = F.when(margin != "", margin).when(page != "", page).otherwise(F.regexp_extract(m, r"\{\{\s*([^}]+?)\s*\}\}", 1))
        return F.struct(kind.alias("kind"), value.alias("value"), at.alias("char_offset"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(one(x["m"], at))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_MARKERS).alias("out"))
    return F.struct(F.regexp_replace(text, _MARK, "").alias("text"), F.aggregate(items, start, step)["out"].alias("markers"))


def _n_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)))


def numbered(files: DataFrame) -> DataFrame:
    """Blocks of (book, file, language, body) with ``block`` (place without footnotes), ``number`` among the book's blocks of its kind, ``margin_base``: margin notes before, and ``numbers`` of its file's footnotes by marker."""
    every = staged(blocks(files))
    book = Window.partitionBy("book").orderBy("file", "position")
    body = F.col("kind") != "footnote"
    keys = every.select("book", "file", "position", "kind", "marker", F.when(F.col("kind").isin("paragraph", "heading"), _n_tokens(F.col("text"))).otherwise(0).alias("tokens"))
    placed = keys.select(
        "book", "file", "position", "kind", "marker",
        F.when(body, F.sum(body.cast("int")).over(Window.partitionBy("book", "file").orderBy("position")) - 1).alias("block"),
        F.row_number().over(Window.partitionBy("book", "kind").orderBy("file", "position")).alias("number"),
        (F.sum("tokens").over(book) - F.col("tokens")).cast("int").alias("margin_base"),
    )
    notes = placed.filter("kind = 'footnote'").groupBy("book", "file").agg(F.map_from_entries(F.collect_list(F.struct("marker", "number"))).alias("numbers"))
    # Joined by key first, so that texts are moved once.
    return every.join(placed.drop("kind", "marker").join(notes, ["book", "file"], "left"), ["book", "file", "position"])


def _margin(text: Column, base: Column) -> Column:
    """Margin tokens as numbered marks; anything of their kind that is left over fails."""
    out = S.each_match(text, _TOKEN, lambda m, i: F.concat(F.lit("{{$m "), (base + i + 1).cast("string"), F.lit("}}")))
    return F.when(F.regexp_replace(out, r"\{\{\$m \d+\}\}", "").contains("{{$"), F.raise_error(F.lit("a margin note does not end or holds a backtick"))).otherwise(out)


def _resolved(text: Column, numbers: Column) -> Column:
    """References by marker as references by number; unknown ones stay."""

    def change(m: Column, _: Column) -> Column:
        number = F.try_element_at(numbers, F.substring(m, F.lit(3), F.char_length(m) - 3))
        return F.coalesce(F.concat(F.lit("[^"), number.cast("string"), F.lit("]")), m)

    return S.each_match(text, _REFERENCE, change)


def _tag_free(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def caption(figure: Column) -> Column:
    """The plain caption; a figure without one fails, since nothing could name it."""
    found = _tag_free(F.regexp_extract(figure, r"(?s)<figcaption[^>]*>(.*?)</figcaption>", 1))
    return F.when(found == "", F.raise_error(F.lit("a figure has no caption"))).otherwise(found)


def figure_html(figure: Column, label: str, number: Column) -> Column:
    """The figure with its number in front of the caption."""
    before = F.concat(F.lit(f"<figcaption><b>{label} "), number.cast("string"), F.lit(".</b> "))
    head, tail = F.regexp_extract(figure, r"(?s)\A(.*?)<figcaption[^>]*>", 1), F.regexp_extract(figure, r"(?s)<figcaption[^>]*>(.*)\z", 1)
    return F.concat(head, before, tail)


def order_of(kind: Column, value: Column) -> Column:
    """Where a mark sorts: pages as ``page_order`` has them, an edition's by its Roman number or the Arabic one."""
    return F.when(kind == "page", X.page_order(value)).otherwise(F.coalesce(X.roman(value), value.try_cast("int"), F.lit(0)))


def _split(markdown: Column, language: Column) -> Column:
    """array of (text, html) of a markdown text without marks, forced boundaries taken."""
    both = F.struct(S.forced(md_to_plain(markdown)).alias("plain"), F.replace(md_to_html(markdown), F.lit("|||"), F.lit("")).alias("html"))
    return S.bound(both, lambda x: S.split_html(x["plain"]["text"], x["html"], language, x["plain"]["positions"]))


def sentences(files: DataFrame, label: str = "Figure") -> DataFrame:
    """A row a sentence: book, file, block, kind, block_number, position, sentence_number, segment, text, html, markers, footnotes, margin_notes.

    ``sentence_number`` runs through the paragraphs of a book; ``segment`` is the run a sentence belongs to; ``markers`` are the page marks in it
    (kind, value, sort_order, char_offset); ``footnotes`` the numbers it refers to; ``margin_notes`` (number, sentences).
    """
    every = numbered(files)
    rows = every.filter("kind <> 'footnote'")
    prose = rows.filter(F.col("kind").isin("heading", "paragraph"))
    tokens = F.transform(F.regexp_extract_all("text", F.lit(r"\{\{\$m\s+`([^`]*)`\}\}"), F.lit(1)), lambda t, i: F.struct((F.col("margin_base") + i + 1).alias("number"), _split(F.trim(t), F.col("language")).alias("sentences")))
    md = _resolved(_margin(F.col("text"), F.col("margin_base")), F.coalesce("numbers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))))
    prose = _once(prose.select("book", "file", "block", "kind", "number", "language", "text", "margin_base", "numbers"), tokens=tokens, md=md).drop("text", "margin_base", "numbers")
    prose = _once(prose, plain=lift(md_to_plain(F.col("md"))), html=F.replace(lift(md_to_html(F.col("md")))["text"], F.lit("|||"), F.lit(""))).drop("md")
    prose = _once(prose, cut=S.forced(F.col("plain.text")))
    prose = _once(prose, pairs=S.split_html(F.col("cut.text"), F.col("html"), F.col("language"), F.col("cut.positions"))).drop("html", "cut")

    def moved(m: Column) -> Column:
        """The mark's offset once ``|||`` is gone."""
        before = F.substring(F.col("plain.text"), F.lit(1), m["char_offset"])
        return m.withField("char_offset", m["char_offset"] - (F.char_length(before) - F.char_length(F.replace(before, F.lit("|||"), F.lit("")))))

    starts = F.concat(F.array(F.lit(0)), S._running(F.transform("pairs", lambda p: F.char_length(p["text"]) + 1)))
    runs = S._running(F.transform("pairs", lambda p: p["text"].startswith(S.RUN).cast("int")))
    prose = _once(prose, starts=F.slice(starts, F.lit(1), F.size("pairs")), runs=runs, markers=F.transform(F.col("plain.markers"), moved)).drop("plain")
    # The last sentence that begins at or before a mark has it.
    owned = F.transform("markers", lambda m: F.struct(F.greatest(F.size(F.filter("starts", lambda s: s <= m["char_offset"])) - 1, F.lit(0)).alias("owner"), m.alias("m")))
    prose = _once(prose, owned=owned)
    # Blocks are cut once, for their sentences and for the numbers of those before.
    return _told(staged(prose.select("book", "file", "block", "kind", "number", F.transform("pairs", _sentence).alias("sentences"))), label, rows)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """The frame with columns that later expressions may name often: behind a generator they are computed once a row."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", made.alias("_made")).select("*", "_made.*").drop("_made")


def _sentence(pair: Column, i: Column) -> Column:
    """What hangs on sentence ``i`` of a block."""
    start, is_run, mine = F.get("starts", i), pair["text"].startswith(S.RUN), F.filter("owned", lambda o: o["owner"] == i)

    def page(o: Column) -> Column:
        m = o["m"]
        offset = F.greatest(m["char_offset"] - start - is_run.cast("int"), F.lit(0))
        return F.struct(m["kind"].alias("kind"), m["value"].alias("value"), order_of(m["kind"], m["value"]).alias("sort_order"), offset.alias("char_offset"))

    def margin(o: Column) -> Column:
        return F.get(F.filter("tokens", lambda t: t["number"] == o["m"]["value"].cast("int")), F.lit(0))

    return F.struct(
        F.regexp_replace(pair["text"], f"^{S.RUN}", "").alias("text"), F.regexp_replace(pair["html"], f"^{S.RUN}", "").alias("html"), F.nullif(F.get("runs", i), F.lit(0)).alias("segment"),
        F.transform(F.filter(mine, lambda o: o["m"]["kind"] != "margin"), page).alias("markers"),
        F.transform(F.regexp_extract_all(pair["html"], F.lit(r"<sup>(\d{1,9})</sup>"), F.lit(1)), lambda n: n.cast("int")).alias("footnotes"),
        F.transform(F.filter(mine, lambda o: o["m"]["kind"] == "margin"), margin).alias("margin_notes"),
    )


def _told(cut: DataFrame, label: str, rows: DataFrame) -> DataFrame:
    earlier = Window.partitionBy("book").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.filter("kind = 'paragraph'").select("book", "file", "block", F.size("sentences").alias("n"))
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    told = cut.join(bases, ["book", "file", "block"], "left").select("book", "file", "block", "kind", "number", "base", F.posexplode("sentences").alias("position", "s")).select("*", "s.*")
    text = told.select(
        "book", "file", "block", "kind", F.when(F.col("kind") == "paragraph", F.col("number")).alias("block_number"), "position", (F.col("base") + F.col("position") + 1).alias("sentence_number"), "segment", "text", "html", "markers", "footnotes", "margin_notes",
    )
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("sentence_number", "bigint"), ("segment", "int"))}
    figure = F.col("kind") == "figure"
    pages = F.transform("markers", lambda m: F.struct(m["kind"].alias("kind"), m["value"].alias("value"), order_of(m["kind"], m["value"]).alias("sort_order"), F.lit(0).alias("char_offset")))
    kinds = {f.name: f.dataType for f in text.schema.fields}
    other = rows.filter(F.col("kind").isin("figure", "separator")).select(
        "book", "file", "block", "kind", F.when(figure, F.col("number")).alias("block_number"), F.lit(0).alias("position"), none["sentence_number"], none["segment"],
        F.when(figure, caption(F.col("text"))).otherwise("").alias("text"), F.when(figure, figure_html(F.col("text"), label, F.col("number"))).otherwise(F.when(F.col("marker") == "***", "dinkus").otherwise("rule")).alias("html"),
        pages.alias("markers"), F.array().cast(kinds["footnotes"]).alias("footnotes"), F.array().cast(kinds["margin_notes"]).alias("margin_notes"),
    )
    return text.unionByName(other)


def footnotes(files: DataFrame) -> DataFrame:
    """book, file, marker, number, markers and sentences (text, html) of each footnote, numbered through the book."""
    notes = numbered(files).filter("kind = 'footnote'")
    return notes.select("book", "file", "marker", "number", "markers", _split(F.col("text"), F.col("language")).alias("sentences"))
