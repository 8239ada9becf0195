"""A table function that turns the body of curated markdown into blocks, for lateral joins.

``SELECT f.name, b.* FROM files f, LATERAL prose_blocks(f.body) b``. Spark spreads the bodies over tasks and runs the function on each; what
needs more than one body (numbers, references, sentences) is joined and windowed afterwards, in ``prose``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sentences import RUN

BLOCKS = "position int, kind string, marker string, text string, markers array<struct<kind:string,value:string,char_offset:int>>"

_NOTE = re.compile(r"\[\^(.*?)\]:(.*)", re.S)
_MARK = re.compile(r"\{\{\{?\s*[^}]+?\s*\}?\}\} ?")
#: The forms of page marks (Arabic with a letter perhaps, or Roman) and of a margin note's number.
_PAGE = re.compile(r"\{\{\{\s*([0-9]+[a-z]?|[IVXLCDM]+)\s*\}\}\}")
_EDITION = re.compile(r"\{\{\s*([^}]+?)\s*\}\}")
_MARGIN = re.compile(r"\{\{\$m (\d+)\}\}")


def lifted(text: str) -> tuple[str, list[tuple[str, str, int]]]:
    """A text without its marks (each with one space behind it), and these as (kind, value, offset in what is left)."""
    out, found, last, size = [], [], 0, 0
    for m in _MARK.finditer(text):
        out.append(text[last : m.start()])
        size += m.start() - last
        last = m.end()
        for kind, form in (("margin", _MARGIN), ("page", _PAGE), ("edition", _EDITION)):
            if hit := form.search(m[0]):
                if kind != "margin" and "$m" in m[0]:
                    raise ValueError(f"margin note where none can be: {m[0]}")
                found.append((kind, hit[1], size))
                break
    return "".join([*out, text[last:]]), found


def parsed(body: str) -> Iterator[tuple[str, str | None, str, list]]:
    """kind, marker, text, marks of each block. Marks stay in headings and paragraphs, which are rendered before they are lifted."""
    lines = [x.removesuffix("\r") for x in body.split("\n")]
    at, end = 0, len(lines)

    def until(stop) -> list[str]:
        """Lines from here to the first that stops, trimmed; that one is left."""
        nonlocal at
        start = at
        while at < end and lines[at].strip() and not stop(lines[at].strip()):
            at += 1
        return [x.strip() for x in lines[start:at]]

    def is_note(line: str) -> bool:
        return _NOTE.match(line) is not None

    while at < end:
        line, at = lines[at].strip(), at + 1
        if not line:
            continue
        if note := _NOTE.match(line):
            text, marks = lifted(" ".join([note[2].strip(), *until(is_note)]))
            yield "footnote", note[1], text, marks
        elif line.startswith("<figure"):
            start = at - 1
            while "</figure>" not in lines[at - 1] and at < end:
                at += 1
            text, marks = lifted("\n".join(lines[start:at]))
            yield "figure", None, text, marks
        elif line in ("---", "***"):
            yield "separator", line, "", []
        elif line.startswith("## "):
            yield "heading", None, line[3:], []
        else:
            every = [line, *until(lambda x: is_note(x) or x.startswith("## "))]
            yield "paragraph", None, " ".join(RUN + x[2:] if x.startswith("+ ") else x for x in every), []


@F.udtf(returnType=BLOCKS)
class ProseBlocks:
    def eval(self, body: str):
        for position, (kind, marker, text, marks) in enumerate(parsed(body or "")):
            yield position, kind, marker, text, [{"kind": k, "value": v, "char_offset": n} for k, v, n in marks]


def register(spark: SparkSession, name: str = "prose_blocks") -> str:
    spark.udtf.register(name, ProseBlocks)
    return name


def blocks(files: DataFrame, body: str = "body") -> DataFrame:
    """The columns of ``files`` but for the body, and each block's position, kind, marker, text and markers. A null or blank body has none."""
    spark, name = files.sparkSession, register(files.sparkSession)
    kept = [f"f.`{c}`" for c in files.columns if c != body]
    return spark.sql(f"SELECT {', '.join([*kept, 'b.*'])} FROM {{files}} f, LATERAL {name}(f.`{body}`) b", files=files)
