"""Sentence splitters as column expressions.

A boundary is a place in the text, the offset where the next sentence begins. Boundaries come from punctuation and from outside (forced
ones); both cut the plain text, and its HTML at the same places: the HTML is read as runs of text between tags, sorted by where they begin
in the plain text, and a boundary falls into the last run that begins before it. Inline tags open at a cut are closed and opened again.
Java's expressions look back, so abbreviations, initials and labels need no second pass; everything stays in the JVM. A null text has
no sentences; very long texts cost time in proportion, but for forced boundaries, whose texts are single blocks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands before a full stop that ends no sentence, in German and English.
ABBREVIATIONS = {
    "de": [
        "bzw.", "usf.", "usw.", "vgl.", "sog.", "evtl.", "bes.", "Anm.", "Bd.", "Kap.", "Nr.", "St.", "Dr.", "Fr.", "Hr.", "Hofr.", " v.", "gl.", "Prof.", "Sr.", "Ew.",
        "Königl.", "Hochfürstl.", "Hochgräfl.", "transz.", "transsc.", "transc.", "transſc.", "transsz.", "transſz.", "transſcend.", "transscend.", "Äſthet.", "Ästhet.",
        "Äſth.", "Ästh.", "Log.", "log.", "Metaph.", "metaph.", "Metaphys.", "Beweisgr.", "Abschn.", "Hauptst.",
    ],
    "en": [
        "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Rev.", "St.", "Jr.", "Sr.", "vs.", "Vol.", "No.", "Gen.", "Gov.", "Sgt.", "Corp.", "Inc.", "Ltd.", "Jan.", "Feb.", "Mar.", "Apr.",
        "Aug.", "Sept.", "Oct.", "Nov.", "Dec.", "Transc.", "transc.", "Aesth.", "aesth.", "Log.", "log.", "Metaph.", "metaph.", "Sect.", "sect.", "Chap.", "chap.", "Introd.",
        "introd.", "Pref.", "pref.",
    ],
}
#: Abbreviations of two parts with space between; in English the first full stop may be missing.
PAIRS = {
    "de": [("d", "i"), ("d", "h"), ("z", "B"), ("z", "E"), ("u", "dgl"), ("r", "V"), ("u", "a"), ("a", "a"), ("u", "ö"), ("s", "o"), ("s", "u"), ("o", "ä")],
    "en": [("e", "g"), ("i", "e"), ("c", "f")],
}
#: Nouns after an ordinal with a full stop; closing and opening characters; inline tags that are closed and opened again at a cut.
ORDINAL_NOUNS = r"Chapters?\b|Cha\.|Psalms?\b|Epistles?\b|Elders\b"
CLOSERS, OPENING = "[)»«\"“”„‟]", "[A-ZÄÖÜ»„“\"(]"
INLINE = ["i", "b", "sup", "sub", "span", "em", "strong", "code", "a", "del"]

RUN = "␞"
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLOCK = 256


def boundary(language: str | None) -> str:
    """The expression of punctuation with the space behind it, after which a sentence begins."""
    singles, pairs = ABBREVIATIONS.get(language, []), PAIRS.get(language, [])
    edge, stop = (r"\b", r"\.?") if language == "en" else ("", r"\.")
    inside = "".join(rf"(?<!{edge}{a}{stop}\s{{0,9}}{b}\.)(?!(?<={edge}{a}\.)\s{{0,9}}{b}\.)" for a, b in pairs)
    after = f"(?<!{'|'.join(map(re.escape, singles))})" if singles else ""
    labels = r"(?<!(?<![\p{L}\p{N}_])[A-ZÄÖÜ]\.)(?<!\A\d{1,2}\.)(?<!\A[IVXLCDM]{1,5}\.)(?<!§\s{0,9}\d{1,2}\.)"
    ordinal = rf"(?!(?<=(?<![\p{{L}}\p{{N}}_])\d{{1,3}}\.){SPACE}+(?:{ORDINAL_NOUNS}))"
    return rf"[.!?]{inside}{CLOSERS}*+{after}{labels}{ordinal}{SPACE}+(?=(?:—{SPACE}+)?{OPENING})"


COLON = rf":{SPACE}+(?=[A-Z])"
STRUCTURAL = rf"[.!?…]+{SPACE}++(?=.)"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def each_match(text: Column, pattern: str, change) -> Column:
    """The text with each match replaced by ``change(match, i)``, i counting from 0."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), F.transform(found, change), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(parts, "")


def _running(lengths: Column) -> Column:
    """Sums of an array of lengths up to each; blocks are folded by themselves, so that appending stays cheap."""

    def fold(part: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")))

    def block(acc: Column, i: Column) -> Column:
        inner = fold(F.slice(lengths, i * BLOCK + 1, F.lit(BLOCK)), acc["at"])
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], inner["out"]).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.when(F.size(lengths) > 0, F.aggregate(blocks, empty, block)["out"]).otherwise(F.array().cast("array<int>"))


def _matched(text: Column, pattern: Column) -> Column:
    """The text up to and with each match, piece by piece; what follows the last match is left out."""
    whole = _whole(text, pattern)
    return bound(whole, lambda x: F.slice(x, F.lit(1), F.size(x) - 1))


def ends(text: Column, pattern: Column) -> Column:
    """Offsets behind the matches of a pattern."""
    return bound(F.transform(_matched(text, pattern), lambda x: F.char_length(x)), _running)


def _boundary(language: Column) -> Column:
    return F.when(language == "de", F.lit(boundary("de"))).when(F.coalesce(language, F.lit("en")) == "en", F.lit(boundary("en"))).otherwise(F.lit(boundary(None)))


def boundaries(text: Column, language: Column, colon: bool = False) -> Column:
    """Offsets where sentences begin after the first; with ``colon`` also after a colon before a capital."""
    found = ends(text, _boundary(language))
    return F.array_sort(F.array_distinct(F.concat(found, ends(text, F.lit(COLON))))) if colon else found


def pieces(text: Column, positions: Column) -> Column:
    """The text cut at ascending offsets; not trimmed, none left out."""

    def cut(bounds: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: F.substring(text, F.get(bounds, i - 1) + 1, F.get(bounds, i) - F.get(bounds, i - 1)))

    return bound(F.concat(F.array(F.lit(0)), positions, F.array(F.char_length(text))), cut)


def _whole(text: Column, pattern: Column) -> Column:
    """The text cut behind each match."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.zip_with(F.split(text, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))


def sentences(text: Column, language: Column, colon: bool = False) -> Column:
    """An array of trimmed sentences, by the language's abbreviations; languages without a list have the other rules only."""
    cut = pieces(text, boundaries(text, language, True)) if colon else _whole(text, _boundary(language))
    return F.filter(F.transform(cut, trimmed), lambda s: s != "")


def _parens(text: Column) -> Column:
    """How deep in brackets each match's end of the structural pattern is; a closing one too many counts for nothing."""

    def walk(depth: Column, piece: Column) -> Column:
        marks = F.filter(F.split(F.regexp_replace(piece, "[^()]", ""), ""), lambda c: c != "")
        return F.aggregate(marks, depth, lambda d, c: F.when(c == "(", d + 1).otherwise(F.greatest(d - 1, F.lit(0))))

    def step(acc: Column, piece: Column) -> Column:
        depth = walk(acc["depth"], piece)
        return F.struct(depth.alias("depth"), F.concat(acc["out"], F.array(depth)).alias("out"))

    return F.aggregate(_matched(text, F.lit(STRUCTURAL)), F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("out")), step)["out"]


def structural_boundaries(text: Column) -> Column:
    """Offsets behind runs of closing punctuation and white space, whatever follows, so that two layers of a text pair; none within brackets."""
    at = ends(text, F.lit(STRUCTURAL))
    inner = F.filter(F.arrays_zip(at.alias("at"), _parens(text).alias("depth")), lambda x: x["depth"] == 0)
    return F.when(F.contains(text, F.lit("(")), F.transform(inner, lambda x: x["at"])).otherwise(at)


def structural(text: Column) -> Column:
    """Sentences by punctuation alone; texts without brackets are split in one go at the space behind punctuation."""
    inner = F.filter(F.transform(pieces(text, structural_boundaries(text)), trimmed), lambda s: s != "")
    plain = F.filter(F.split(trimmed(text), rf"(?={SPACE})(?<=[.!?…]){SPACE}++", -1), lambda s: s != "")
    return F.when(F.contains(text, F.lit("(")), inner).otherwise(plain)


def verses(text: Column) -> Column:
    """Split where closing punctuation is followed by a capital, perhaps quoted; a verse that doesn't end is one sentence."""
    return F.filter(F.split(F.regexp_replace(F.trim(text), r"([.!?][”’\"')]*)\s+(?=[“‘\"'(]?\p{Lu})", "$1\u0001"), "\u0001"), lambda s: s != "")


def forced(text: Column) -> Column:
    """struct(text, positions): ``|||`` is taken out and a run's mark kept; at both a sentence must begin."""
    found = F.regexp_extract_all(text, F.lit(rf"(\|\|\||{RUN})"), F.lit(1))
    gaps = F.slice(F.split(text, rf"\|\|\||{RUN}", -1), F.lit(1), F.size(found))
    items = F.zip_with(gaps, found, lambda a, b: F.struct(F.char_length(a).alias("gap"), (b == RUN).cast("int").alias("kept")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        return F.struct((at + x["kept"]).alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.struct(F.replace(text, F.lit("|||"), F.lit("")).alias("text"), F.aggregate(items, empty, step)["out"].alias("positions"))


#: A footnote's reference, which the plain text lacks, or one tag.
_SKIPPED = r"(?s:<sup>.*?</sup>)|<[^>]*>?"


def html_runs(html: Column) -> Column:
    """The runs of text between tags: array of (plain, html), where each begins in the plain text and in the HTML."""
    gaps = F.split(html, _SKIPPED, -1)
    tags = F.regexp_extract_all(html, F.lit(_SKIPPED), F.lit(0))
    items = F.zip_with(gaps, tags, lambda g, t: F.struct(F.char_length(g).alias("n"), F.coalesce(F.char_length(t), F.lit(0)).alias("skip")))
    empty = F.struct(F.lit(0).alias("plain"), F.lit(0).alias("html"), F.array().cast("array<struct<plain:int,html:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = F.array(F.struct(acc["plain"].alias("plain"), acc["html"].alias("html")))
        out = F.when(x["n"] > 0, F.concat(acc["out"], here)).otherwise(acc["out"])
        return F.struct((acc["plain"] + x["n"]).alias("plain"), (acc["html"] + x["n"] + x["skip"]).alias("html"), out.alias("out"))

    return F.aggregate(items, empty, step)["out"]


def html_positions(html: Column, positions: Column) -> Column:
    """Where offsets of the plain text lie in the HTML: in the last run that begins before them, so in front of tags that open there."""

    def place(runs: Column, p: Column) -> Column:
        last = F.array_max(F.filter(runs, lambda r: r["plain"] < p))
        return F.least(F.coalesce(last["html"] + p - last["plain"], F.lit(0)), F.char_length(html))

    return bound(html_runs(html), lambda runs: F.transform(positions, lambda p: place(runs, p)))


def _opened(segment: Column, stack: Column) -> Column:
    """The inline tags open behind a segment, as they were written, without their brackets."""

    def step(acc: Column, tag: Column) -> Column:
        name = F.regexp_extract(tag, r"^</?([^> ]*)", 1)
        n = F.size(acc)
        last = F.array_position(F.reverse(F.transform(acc, lambda t: (t == name) | t.startswith(F.concat(name, F.lit(" "))))), F.lit(True)).cast("int")
        closed = F.when(last > 0, F.concat(F.slice(acc, F.lit(1), n - last), F.slice(acc, n - last + 2, n))).otherwise(acc)
        open_ = F.when(tag.endswith("/>"), acc).otherwise(F.concat(acc, F.array(F.substring(tag, F.lit(2), F.char_length(tag) - 2))))
        return F.when(~name.isin(INLINE), acc).when(tag.startswith("</"), closed).otherwise(open_)

    return F.aggregate(F.regexp_extract_all(segment, F.lit("<[^>]*>"), F.lit(0)), stack, step)


def cut_html(html: Column, positions: Column) -> Column:
    """The HTML cut at offsets of its plain text; inline tags open at a cut are closed there and opened again behind it."""

    def step(acc: Column, segment: Column, last: Column) -> Column:
        def built(after: Column) -> Column:
            whole = F.concat(F.array_join(F.transform(acc["open"], lambda t: F.concat(F.lit("<"), t, F.lit(">"))), ""), segment)
            closing = F.array_join(F.transform(F.reverse(after), lambda t: F.concat(F.lit("</"), F.substring_index(t, " ", 1), F.lit(">"))), "")
            out = F.when(last | (F.size(after) == 0), whole).otherwise(F.concat(F.regexp_replace(whole, rf"{SPACE}+\z", ""), closing))
            return F.struct(after.alias("open"), F.concat(acc["out"], F.array(out)).alias("out"))

        return bound(_opened(segment, acc["open"]), built)

    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("open"), empty.alias("out"))
    return bound(pieces(html, html_positions(html, positions)), lambda cut: F.aggregate(cut, start, lambda acc, x: step(acc, x, F.size(acc["out"]) == F.size(cut) - 1))["out"])


def paired(text: Column, html: Column, positions: Column) -> Column:
    """array of (text, html): both layers cut at the same offsets and trimmed; pieces without text are left out."""

    def layers(at: Column) -> Column:
        return F.zip_with(pieces(text, at), cut_html(html, at), lambda a, b: F.struct(trimmed(a).alias("text"), trimmed(b).alias("html")))

    return F.filter(bound(positions, layers), lambda x: x["text"] != "")


def split_html(text: Column, html: Column, language: Column, extra: Column | None = None, colon: bool = False) -> Column:
    """Sentences of a block in both layers, by punctuation and at the ``extra`` offsets."""
    given = [text.alias("text"), html.alias("html"), *([] if extra is None else [extra.alias("extra")])]

    def layers(x: Column) -> Column:
        found = boundaries(x["text"], language, colon)
        return paired(x["text"], x["html"], found if extra is None else F.array_sort(F.array_distinct(F.concat(found, x["extra"]))))

    return bound(F.struct(*given), layers)
