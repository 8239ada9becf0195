"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Transliterations of a slug.
TRANSLITERATED = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "é": "e", "è": "e", "ê": "e", "à": "a", "â": "a", "ç": "c", "î": "i", "ô": "o", "û": "u", "ñ": "n", "í": "i", "ó": "o", "á": "a", "ú": "u"}


def normalise(text: Column) -> Column:
    """Trimmed, lower case, runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, on normalised texts; two empty texts are equal."""
    x, y = normalise(a), normalise(b)
    longest = F.greatest(F.char_length(x), F.char_length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein's distance, computed between what equal beginnings and ends leave: long texts with one change cost little."""

    def common(x: Column, y: Column) -> Column:
        n = F.least(F.char_length(x), F.char_length(y))
        differ = F.array_position(F.zip_with(F.split(F.substring(x, F.lit(1), n), ""), F.split(F.substring(y, F.lit(1), n), ""), lambda p, q: p != q), F.lit(True))
        return F.when(differ > 0, differ - 1).otherwise(n).cast("int")

    def between(c: Column) -> Column:
        x, y = (F.substring(c[k], c["head"] + 1, F.char_length(c[k])) for k in ("a", "b"))
        return F.struct(x.alias("x"), y.alias("y"), common(F.reverse(x), F.reverse(y)).alias("tail"))

    def rest(c: Column) -> Column:
        return F.levenshtein(*(F.substring(c[k], F.lit(1), F.char_length(c[k]) - c["tail"]) for k in "xy"))

    cut = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"), common(a, b).alias("head"))), between)
    return F.get(F.transform(cut, rest), F.lit(0))


def similar(x: Column, y: Column) -> Column:
    """``similarity`` of texts that are normalised already."""
    longest = F.greatest(F.char_length(x), F.char_length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - edit_distance(x, y) / longest)


def concat_similarity(whole: Column, parts: Column) -> Column:
    """Similarity of a text with an array of parts, normalised and joined by one space."""
    return similarity(whole, F.concat_ws(" ", F.transform(parts, normalise)))


def slug(text: Column, transliterate: bool = True) -> Column:
    """Lower case, other than a-z and 0-9 as single hyphens, none at the ends."""
    out = F.lower(text)
    if transliterate:
        for a, b in TRANSLITERATED.items():
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def sort_name(name: Column) -> Column:
    """'First Middle Last' as 'Last, First Middle'; single words stay."""
    whole = F.trim(name)
    last = F.regexp_extract(whole, r"(\S+)$", 1)
    return F.when(~whole.contains(" "), whole).otherwise(F.concat(last, F.lit(", "), F.regexp_replace(whole, r"\s+\S+$", "")))


def surname(name: Column) -> Column:
    """What stands before the comma of a name to sort by; without a comma the last word."""
    return F.when(name.contains(","), F.trim(F.substring_index(name, ",", 1))).otherwise(F.regexp_extract(F.trim(name), r"(\S+)$", 1))


def like_escaped(query: Column) -> Column:
    """A query for LIKE with its wildcards taken literally."""
    return F.regexp_replace(query, r"([\\%_])", r"\\$1")


def excerpt(text: Column, n: int = 300) -> Column:
    """At most n characters, cut at the last space if that is past half, without trailing , ; : and with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(flat, 1, n)
    space = F.char_length(head) - F.char_length(F.regexp_extract(head, r"[^ ]*$", 0))
    cut = F.when(space - 1 > n // 2, F.substring(head, F.lit(1), space - 1)).otherwise(head)
    return F.when(F.char_length(flat) <= n, flat).otherwise(F.concat(F.regexp_replace(cut, "[,;: ]+$", ""), F.lit("…")))


def contained_form(text: Column) -> Column:
    """Words only, for meeting texts by their words: tags and entities dropped, lower case, punctuation as single spaces, padded."""
    plain = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "&[a-zA-Z0-9#]+;", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def letters(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def contains_quote(html: Column, quote: Column) -> Column:
    """Whether the quote's letters and digits stand in the text that the HTML shows, without gaps; an empty quote is in any."""
    plain = F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "&[a-zA-Z0-9#]+;", " ")
    return F.contains(letters(plain), letters(quote))


def badge(publisher: Column, language: Column) -> Column:
    return F.when(F.char_length(publisher) <= 6, publisher).otherwise(F.upper(language))


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def md_to_html(text: Column) -> Column:
    """Bold-italic, bold and italic runs as tags, longest marks first."""
    out = F.regexp_replace(text, r"\*\*\*(.+?)\*\*\*", "<b><i>$1</i></b>")
    return F.regexp_replace(F.regexp_replace(out, r"\*\*(.+?)\*\*", "<b>$1</b>"), r"\*(.+?)\*", "<i>$1</i>")


def md_to_plain(text: Column) -> Column:
    """Without footnote references, emphasis marks and tags."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\^[^\]]+\]", ""), r"\*+|</?[a-z]+[^>]*>", "")


def indent(line: Column) -> Column:
    """Levels of two leading spaces; null below one level."""
    n = F.char_length(line) - F.char_length(F.ltrim(line))
    return F.when(n >= 2, F.floor(n / 2).cast("int"))


def roman(value: Column) -> Column:
    """The number of a Roman numeral in either case; null for anything else."""
    digits = F.transform(F.split(F.upper(value), ""), lambda c: F.coalesce(*[F.when(c == k, F.lit(n)) for k, n in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000))], F.lit(0)))
    total = F.aggregate(F.reverse(digits), F.struct(F.lit(0).alias("t"), F.lit(0).alias("m")), lambda a, d: F.struct((a["t"] + F.when(d < a["m"], -d).otherwise(d)).alias("t"), F.greatest(a["m"], d).alias("m")))["t"]
    return F.when(value.rlike("^[IVXLCDMivxlcdm]+$"), total)


def page_order(value: Column) -> Column:
    """Order of page labels: Arabic as they are, '247b' as 247, Roman before all, anything else 0."""
    arabic = F.regexp_extract(value, "^([0-9]{1,9})[a-z]?$", 1)
    return F.when(arabic != "", arabic.try_cast("int")).otherwise(F.coalesce(roman(value) - 10000, F.lit(0)))


def cite_inline(names: Column, original: Column, published: Column) -> Column:
    """'A', 'A and B' or 'A et al.' with the year of publication, '[orig] pub' for reprints, 'n.d.' without one; 'Unknown' without names."""
    who = F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, F.lit("Unknown")).when(F.size(names) == 1, surname(F.get(names, F.lit(0)))).when(F.size(names) == 2, F.concat(surname(F.get(names, F.lit(0))), F.lit(" and "), surname(F.get(names, F.lit(1))))).otherwise(F.concat(surname(F.get(names, F.lit(0))), F.lit(" et al.")))
    reprint = original.isNotNull() & published.isNotNull() & (original != published)
    year = F.when(reprint, F.concat(F.lit("["), original.cast("string"), F.lit("] "), published.cast("string"))).otherwise(F.coalesce(published.cast("string"), F.lit("n.d.")))
    return F.concat_ws(" ", who, year)
