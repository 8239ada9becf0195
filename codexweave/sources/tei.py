"""TEI and other XML with milestones: overlapping hierarchies as ranges over one text.

A table function reads a file's XML into events in document order; elements, pages and lines then are ranges of offsets in the text, found by
windows over the events of a file: an element from where it opens to where it closes, a milestone (an empty element such as a page's
beginning) from where it stands to the next of its kind. Which paragraphs a page touches is an overlap join of ranges. The converters to
markdown sort the pieces of a block by their place and join them, and rejoin what lines and pages have torn by expressions over the whole.
"""

from __future__ import annotations

import xml.parsers.expat
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import sentences as S
from ..operators.lineage import lean, staged

EVENTS = "n int, kind string, name string, attrs map<string,string>, text string, path array<struct<id:int,name:string>>"
#: Events of a batch, those of the last file in it whole.
AT_ONCE = 20_000
#: Renditions that carry meaning, and divisions that are none of the text's.
EMPHASIS = {"#i": "_", "#g": "***", "#k": "**"}
SKIPPED = ["contents", "imprint", "advertisement"]

SOFT, LINE = "‐", "\x00"
#: Stand for emphasis that begins or ends, by kind, until a block's text is whole.
_OPEN, _CLOSE = "\ue001\ue002\ue003", "\ue011\ue012\ue013"


def read_events(source: str) -> Iterator[tuple]:
    """open, close and text in document order; ``path`` has the elements around, the element itself last. Namespaces are dropped."""
    out, stack, n = [], [], 0
    parser = xml.parsers.expat.ParserCreate()
    parser.buffer_text = True

    def put(kind, name=None, attrs=None, text=None):
        nonlocal n
        out.append((n, kind, name, attrs, text, list(stack)))
        n += 1

    def opened(name, attrs):
        name = name.rpartition(":")[2]
        stack.append((n, name))
        put("open", name, {k.rpartition(":")[2]: v for k, v in attrs.items()})

    def closed(name):
        put("close", name.rpartition(":")[2])
        stack.pop()

    parser.StartElementHandler, parser.EndElementHandler = opened, closed
    parser.CharacterDataHandler = lambda text: put("text", text=text)
    parser.Parse(source.encode(), True)
    yield from out


def _batch(files: pa.Array, counts: list[int], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Events of some files as columns; paths and attributes are laid end to end, without an object for each event."""
    n, kind, name, attrs, text, path = zip(*rows)
    steps = [x for p in path for x in p]
    pairs = [x for a in attrs for x in (a or {}).items()]
    around = pa.StructArray.from_arrays([pa.array([x[i] for x in steps], t) for i, t in enumerate((pa.int32(), pa.string()))], ["id", "name"])
    paths = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, path)]), pa.int32()), around)
    ends = np.cumsum([0, *(len(a or ()) for a in attrs)])
    absent = np.array([*(a is None for a in attrs), False])
    maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32(), mask=absent), pa.array([x[0] for x in pairs], pa.string()), pa.array([x[1] for x in pairs], pa.string()))
    columns = [files.take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(n, pa.int32()), pa.array(kind), pa.array(name, pa.string()), maps, pa.array(text, pa.string()), paths]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _events(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begun, counts, rows = 0, [], []
        for i, source in enumerate(batch["xml"]):
            some = list(read_events(source.as_py())) if source.as_py() else []
            counts.append(len(some))
            rows += some
            if rows and (len(rows) >= AT_ONCE or i + 1 == len(batch)):
                yield _batch(batch["file"].slice(begun, len(counts)), counts, rows, schema)
                begun, counts, rows = i + 1, [], []


def events(files: DataFrame, key: str = "file", xml: str = "xml") -> DataFrame:
    """file and its events; a null or empty source has none, one that is no XML fails."""
    some = lean(files).select(F.col(f"`{key}`").alias("file"), F.col(f"`{xml}`").alias("xml"))
    schema = StructType([some.schema["file"], *StructType.fromDDL(EVENTS).fields])
    arrow = to_arrow_schema(schema)
    return some.mapInArrow(lambda batches: _events(batches, arrow), schema)


def placed(found: DataFrame) -> DataFrame:
    """Events with ``at``: the offset in the file's text where they stand. Written once, as ranges of every kind read them, so that files are read once too."""
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return staged(found.withColumn("at", F.coalesce(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).over(before), F.lit(0))))


def milestone_ranges(at: DataFrame, name: str, unit: str | None = None) -> DataFrame:
    """file, n, label, start, stop of milestones of a name (and unit): each reaches to the next one, the last to the text's end."""
    sizes = at.groupBy("file").agg(F.max(F.col("at") + F.coalesce(F.char_length("text"), F.lit(0))).alias("size"))
    mine = at.filter((F.col("kind") == "open") & (F.col("name") == name) & (F.lit(True) if unit is None else F.col("attrs")["unit"] == unit))
    order = Window.partitionBy("file").orderBy("n")
    ranges = mine.select("file", "n", F.col("attrs")["n"].alias("label"), F.col("at").alias("start"), F.lead("at").over(order).alias("next"))
    return ranges.join(sizes, "file").select("file", "n", "label", "start", F.coalesce("next", "size").alias("stop"))


def element_ranges(at: DataFrame, name: str) -> DataFrame:
    """file, n, start, stop of elements of a name, nested ones too."""
    own = F.element_at("path", -1)["id"]
    mine = at.filter((F.col("name") == name) & F.col("kind").isin("open", "close")).select("file", own.alias("n"), "at")
    return mine.groupBy("file", "n").agg(F.min("at").alias("start"), F.max("at").alias("stop"))


def _nearest(name_test) -> Column:
    """The innermost element around that passes, as (id, name)."""
    return F.try_element_at(F.filter("path", name_test), F.lit(-1))


def normalised(text: Column) -> Column:
    """Hyphens that lines have torn rejoined, page marks moved behind the word, line ends as single spaces."""
    ws, brk, brks, mark = r"[ \t\r\n]*", r"[ \t\r\n]*(?:\x00[ \t\r\n]*)*", r"[ \t\r\n]*(?:\x00[ \t\r\n]*)+", r"(\{\{\{[^{}]*\}\}\})"
    steps = [
        (rf"{SOFT}(\]+){brk}{mark}{ws}(\S+)", "-$1$3 $2 "), (rf"{SOFT}(\]+){brk}", "-$1"), (rf"{SOFT}{brk}{mark}{ws}(\S+)", "$2 $1 "),
        (rf"{SOFT}([_*]+){brk}([^\s_*{{]+)", "$2$1"), (rf"{SOFT}{brk}", ""), (rf"-{brks}{mark}{ws}(\S+)", "-$2 $1 "), (rf"-{brks}", "-"), (rf"{ws}\x00{ws}", " "), (r"[ \t\r\n]+", " "),
    ]
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def _intraword(md: Column) -> Column:
    """Emphasis that begins or ends within a word as a tag."""
    found, parts = F.regexp_extract_all(md, F.lit("_([^_]+)_"), F.lit(0)), F.split(md, "_([^_]+)_", -1)

    def one(m: Column, i: Column) -> Column:
        hugs = F.get(parts, i).rlike(r"[\p{L}\p{N}]\z") | F.get(parts, i + 1).rlike(r"\A[\p{L}\p{N}]")
        return F.when(hugs, F.concat(F.lit("<i>"), F.substring(m, F.lit(2), F.char_length(m) - 2), F.lit("</i>"))).otherwise(m)

    return F.array_join(F.zip_with(parts, F.transform(found, one), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _torn(found: DataFrame) -> DataFrame:
    """Words whose last hyphen a line has torn: the next word has no norm of its own, and a line begins between them or in it. file, word."""
    word = F.element_at("path", -1)["id"]
    lines = F.sum(F.when((F.col("name") == "lb") & (F.col("kind") == "open"), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("n"))
    counted = found.withColumn("lines", lines)
    bounds = counted.filter("name = 'w'").groupBy("file", word.alias("word")).agg(
        F.max(F.when(F.col("kind") == "open", F.col("lines"))).alias("first"), F.max(F.when(F.col("kind") == "close", F.col("lines"))).alias("last"),
        F.max(F.when(F.col("kind") == "open", F.col("attrs")["norm"])).alias("norm"),
    )
    texts = found.filter("kind = 'text'").withColumn("word", _nearest(lambda x: x["name"] == "w")["id"]).filter("word IS NOT NULL")
    joined = texts.groupBy("file", "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "").alias("said"), F.max("n").alias("end"))
    order = Window.partitionBy("file").orderBy("word")
    words = bounds.join(joined, ["file", "word"], "left").withColumn("next_norm", F.lead("norm").over(order)).withColumn("next_last", F.lead("last").over(order))
    torn = words.filter(F.rtrim("said").endswith("-") & F.col("next_norm").isNull() & (F.col("next_last") > F.col("first")))
    return torn.select("file", F.col("end").alias("n"), F.lit(True).alias("torn"))


def _pieces(found: DataFrame, layer: str) -> DataFrame:
    """What each event gives to the markdown and to the plain text of the block around it (a paragraph, verse line or head)."""
    other = "corr" if layer == "sic" else "sic"
    block = _nearest(lambda x: x["name"].isin("p", "l", "head"))["id"]
    in_choice = F.exists("path", lambda x: x["name"] == "choice") & F.exists("path", lambda x: x["name"] == other)
    kept = found.withColumn("block", block).filter(F.col("block").isNotNull() & ~in_choice & ~F.exists("path", lambda x: x["name"] == "fw"))
    order = Window.partitionBy("file", "block").orderBy("n")
    in_word = F.exists("path", lambda x: x["name"] == "w")
    line = (F.col("kind") == "open") & (F.col("name") == "lb")
    # A hyphen before a line within a word, or at the end of a torn word.
    ahead = F.lead(F.when(line & in_word, True)).over(order)
    soft = F.coalesce(ahead, F.lit(False)) & F.col("text").endswith("-") & in_word | F.coalesce("torn", F.lit(False)) & F.rtrim("text").endswith("-")
    text = F.when(soft, F.regexp_replace("text", r"-(\s*)\z", f"{SOFT}$1")).otherwise(F.col("text"))
    mark = F.coalesce(*[F.when(F.col("rendition") == k, F.when(F.col("kind") == "open", _OPEN[i]).otherwise(_CLOSE[i])) for i, k in enumerate(EMPHASIS)])
    page = F.concat(F.lit(" {{{ "), F.col("attrs")["n"], F.lit(" }}} "))
    name, is_open = F.col("name"), F.col("kind") == "open"
    plain = F.when(F.col("kind") == "text", text).when(line, LINE)
    md = (
        F.when(F.col("kind") == "text", F.regexp_replace(text, r"([_*\[])", r"\\$1")).when(line, LINE).when(is_open & (name == "pb"), page)
        .when(name == "supplied", F.when(is_open, "[").otherwise("]"))
        .when(name == "hi", mark)
    )
    rendition = found.filter("kind = 'open' AND name = 'hi'").select("file", F.col("n").alias("hi"), F.col("attrs")["rendition"].alias("rendition"))
    kept = kept.withColumn("hi", F.when(F.col("name") == "hi", F.element_at("path", -1)["id"]))
    kept = kept.join(rendition, ["file", "hi"], "left").join(_torn(found), ["file", "n"], "left")
    return kept.select("file", "block", "n", plain.alias("plain"), md.alias("md")).filter("plain IS NOT NULL OR md IS NOT NULL")


def _hugged(md: Column) -> Column:
    """Emphasis marks moved inwards to the text, dropped around nothing, and spelled out."""
    blank = r"[\s\x00]*"
    md = F.regexp_replace(md, f"[{_OPEN}]({blank})[{_CLOSE}]", "$1")
    md = F.regexp_replace(F.regexp_replace(md, f"([{_OPEN}]+)({blank})", "$2$1"), f"({blank})([{_CLOSE}]+)", "$2$1")
    for i, delimiter in enumerate(EMPHASIS.values()):
        md = F.regexp_replace(md, f"[{_OPEN[i]}{_CLOSE[i]}]", delimiter.replace("$", r"\$"))
    return md


def texts(found: DataFrame, layer: str = "sic") -> DataFrame:
    """file, block (the opening event's number), md, plain of paragraphs, verse lines and heads; ``layer``: the branch of a choice that is read."""

    def joined(c: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: F.coalesce(x[c], F.lit(""))), "")

    blocks = _pieces(found, layer).groupBy("file", "block").agg(joined("md").alias("md"), joined("plain").alias("plain"))
    return blocks.select("file", "block", _intraword(normalised(_hugged(F.col("md")))).alias("md"), normalised(F.col("plain")).alias("plain"))


def _content(name: str = "name", kind: str = "attrs") -> Column:
    return (F.col(name) == "div") & ~F.coalesce(F.col(kind)["type"].isin(SKIPPED), F.lit(False))


def slug(label: Column) -> Column:
    """Letters and digits in lower case with umlauts spelled out, anything else as single underscores."""
    out = F.lower(label)
    for a, b in (("ſ", "s"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "_"), "^_|_$", "")


def nodes(found: DataFrame, supplied: str = "Einleitung", layer: str = "sic") -> DataFrame:
    """file, div, position, depth, page (open where it begins), heading_page (pages that begin with it), label, slug of the divisions that count."""
    order = Window.partitionBy("file").orderBy("n")
    opens = found.filter("kind = 'open'")
    parent = F.get("path", F.size("path") - 2)["id"]
    divs = opens.filter(_content()).select("file", F.col("n").alias("div"))
    tagged = opens.withColumn("parent", parent).join(divs.withColumnRenamed("div", "parent").withColumn("under", F.lit(True)), ["file", "parent"], "left")
    clears = _content() | (F.col("name").isin("p", "lg") & F.col("under"))
    free = (F.col("name") == "pb") & F.col("attrs")["n"].isNotNull() & ~F.exists("path", lambda x: x["name"].isin("p", "lg", "head"))
    page = F.last(F.when(F.col("name") == "pb", F.col("attrs")["n"]), ignorenulls=True).over(order)
    group = F.sum(F.coalesce(clears, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = tagged.withColumn("page", page).withColumn("group", F.coalesce(group, F.lit(0))).withColumn("free", F.when(free, F.col("attrs")["n"]))
    pending = told.groupBy("file", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("free").isNotNull(), F.struct("n", "free")))), lambda x: x["free"]), " ").alias("heading_page"))
    heads = opens.filter("name = 'head'").select("file", F.col("n").alias("block"), parent.alias("div")).join(texts(found, layer), ["file", "block"], "left")
    heads = heads.groupBy("file", "div").agg(F.min(F.struct("block", "plain")).alias("h"))
    depth = F.size(F.filter("path", lambda x: x["name"] == "div"))
    rows = told.filter(_content()).select("file", F.col("n").alias("div"), "group", "page", depth.alias("depth"), F.row_number().over(order).alias("position"))
    label = F.nullif(F.rtrim(F.regexp_replace(F.coalesce("h.plain", F.lit("")), r"\.\z", "")), F.lit(""))
    out = rows.join(pending, ["file", "group"], "left").join(heads, ["file", "div"], "left").withColumn("label", F.coalesce(label, F.lit(supplied)))
    return out.select("file", "div", "position", "depth", "page", F.nullif("heading_page", F.lit("")).alias("heading_page"), "label", slug(F.col("label")).alias("slug"))


def blocks(found: DataFrame, layer: str = "sic") -> DataFrame:
    """file, div, position, md: each division's own paragraphs, verses and the rules that stand between two of them; a page that begins between blocks leads the next one."""
    opens = found.filter("kind = 'open'").withColumn("parent", F.get("path", F.size("path") - 2))
    divs = opens.filter(_content()).select("file", F.col("n").alias("div"))
    text = texts(found, layer)
    direct = opens.withColumn("div", F.col("parent.id")).join(divs, ["file", "div"])
    prose = direct.filter("name = 'p'").select("file", "div", F.col("n").alias("block"), F.col("n").alias("group"), F.lit("").alias("lead"))
    groups = direct.filter("name = 'lg'").select("file", "div", F.col("n").alias("group"))
    verse = opens.filter("name = 'l' AND parent.name = 'lg'").select("file", F.col("n").alias("block"), F.col("parent.id").alias("group")).join(groups, ["file", "group"])
    lines = prose.unionByName(verse.select("file", "div", "block", "group", F.lit("| ").alias("lead"))).join(text.select("file", "block", "md"), ["file", "block"], "left")
    lines = lines.filter((F.coalesce("md", F.lit("")) != "") | (F.col("lead") != "")).withColumn("md", F.coalesce("md", F.lit("")))
    between = direct.filter("name IN ('pb', 'milestone')").select("file", "div", F.col("n").alias("block"), F.when(F.col("name") == "pb", F.col("attrs")["n"]).alias("page"), (F.col("name") == "milestone").alias("rule"))
    every = lines.unionByName(between, allowMissingColumns=True)
    order = Window.partitionBy("file", "div").orderBy("block")
    count = F.coalesce(F.sum(F.col("md").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = Window.partitionBy("file", "div", "so_far").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    told = every.withColumn("so_far", count).withColumn("pending", F.last("page", ignorenulls=True).over(inner)).withColumn("ruled", F.max(F.coalesce("rule", F.lit(False))).over(inner)).filter("md IS NOT NULL")
    marked = F.concat(F.col("lead"), F.when(F.col("pending").isNotNull(), F.concat(F.lit("{{{ "), F.col("pending"), F.lit(" }}} "))).otherwise(""), F.col("md"))
    whole = told.withColumn("line", marked).groupBy("file", "div", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line"))), lambda x: x["line"]), "\n").alias("md"), F.min(F.struct("block", "ruled", "so_far")).alias("m"))
    rows = whole.select("file", "div", "group", F.explode(F.when(F.col("m.ruled") & (F.col("m.so_far") > 0), F.array(F.lit("---"), F.col("md"))).otherwise(F.array("md"))).alias("md"))
    rule = (F.col("md") != "---").cast("int")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("file", "div").orderBy("group", rule)) - 1).select("file", "div", "position", "md")
