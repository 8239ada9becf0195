"""Citations as texts: entries of a bibliography, groups in a text, passages by a book's own numbering, and the directives that embed passages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sentences import bound

#: Kinds a directive can name, the first of them if it names none.
KINDS = ("body", "footnote", "figure")


def _filled(text: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def bibliography_entry(sort_names: Column, names: Column, role: Column, original: Column, published: Column, title: Column, edition: Column, place: Column, publisher: Column) -> Column:
    """An entry by author and date: the first name inverted, the others as they are, ``role`` ('ed.', 'trans.') for names that aren't authors; the title leads if there are no names.

    What is null or blank of edition, place and publisher is left out; a reprint has its original year in parentheses before its own.
    """
    year = F.coalesce(F.when(original != published, F.format_string("(%d) %d.", original, published)), F.format_string("%d.", published), F.lit("n.d."))
    year = F.when(published.isNull(), F.lit("n.d.")).otherwise(year)
    more = F.slice(names, F.lit(2), F.greatest(F.size(names) - 2, F.lit(0)))
    who = F.array_join(F.concat(F.array(F.get(sort_names, F.lit(0))), more), ", ")
    who = F.when(F.size(sort_names) > 1, F.concat(who, F.lit(", and "), F.element_at(names, -1))).otherwise(who)
    who = F.when(F.size(sort_names) > 0, F.coalesce(F.concat(who, F.lit(", "), role), F.concat(who, F.lit("."))))
    italic = F.concat(F.lit("<em>"), title, F.lit("</em>."))
    facts = F.concat(F.concat_ws(": ", _filled(place), _filled(publisher)), F.lit("."))
    rest = [F.concat(_filled(edition), F.lit(".")), F.when(facts != ".", facts)]
    return F.when(who.isNull(), F.concat_ws(" ", italic, year, *rest)).otherwise(F.concat_ws(" ", who, year, italic, *rest))


def cited_together(citations: Column) -> Column:
    """An array of structs ``citation`` and ``pages`` as one pair of parentheses; blank pages are left out."""
    return F.concat(F.lit("("), F.array_join(F.transform(citations, lambda c: F.concat_ws(", ", c["citation"], F.nullif(c["pages"], F.lit("")))), "; "), F.lit(")"))


def passage_locator(systems: Column, parent: Column, node: Column, sentence: Column) -> Column:
    """Where a passage stands, by each of the book's systems: structs ``template`` (with {parent}, {self}, {ref}), ``first_ref``, ``last_ref``; by node and sentence if it has none."""

    def one(s: Column) -> Column:
        ref = F.concat(s["first_ref"], F.coalesce(F.concat(F.lit("–"), F.nullif(F.nullif(s["last_ref"], F.lit("")), s["first_ref"])), F.lit("")))
        out = s["template"]
        for mark, value in (("{parent}", F.coalesce(parent, F.lit(""))), ("{self}", node), ("{ref}", ref)):
            out = F.replace(out, F.lit(mark), value)
        return F.regexp_replace(out, r"^\s+|\s+$", "")

    return F.when(F.size(systems) > 0, F.array_join(F.transform(systems, one), " · ")).otherwise(F.concat(node, F.lit(" · "), sentence))


_QUOTED, _BARE = r'(?U)(\w+)="([^"]*)"', r"(?U)(\w+)=(\d+)"


def _attributes(body: Column, names: list[str], use) -> Column:
    """``use`` of a struct of each name's first value, of the quoted ones before the bare numbers; the text is read once for all."""
    lists = F.struct(*[F.regexp_extract_all(body, F.lit(p), F.lit(i)).alias(f"{n}{i}") for n, p in (("quoted", _QUOTED), ("bare", _BARE)) for i in (1, 2)])

    def value(x: Column, name: str) -> Column:
        return F.coalesce(*[F.get(x[f"{n}2"], (F.array_position(x[f"{n}1"], name) - 1).cast("int")) for n in ("quoted", "bare")])

    return bound(lists, lambda x: bound(F.struct(*[value(x, n).alias(n) for n in names]), use))


def quotation_directives(markdown: Column) -> Column:
    """The ``::quotation{…}`` of a text in order: structs book, start, end, kind.

    Left out are those without a book or a whole number as start, or of an unknown kind. An end before the start changes places with it; one equal to it, or that is no number, is null.
    """

    def number(text: Column) -> Column:
        return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))

    def told(d: Column) -> Column:
        a, b = d["start"], d["end"]
        last = F.nullif(F.greatest(a, b), F.least(a, b))
        return F.struct(d["book"].alias("book"), F.least(a, b).alias("start"), last.alias("end"), d["kind"].alias("kind"), a.isNotNull().alias("ok"))

    def one(body: Column) -> Column:
        read = lambda d: F.struct(d["book"].alias("book"), number(d["start"]).alias("start"), number(d["end"]).alias("end"), F.coalesce(d["kind"], F.lit(KINDS[0])).alias("kind"))
        return _attributes(body, ["book", "start", "end", "kind"], lambda d: bound(read(d), told))

    found = F.transform(F.regexp_extract_all(markdown, F.lit(r"::quotation\{([^}]+)\}"), F.lit(1)), one)
    good = F.filter(found, lambda d: F.coalesce(d["book"] != "", F.lit(False)) & d["ok"] & d["kind"].isin(*KINDS))
    return F.transform(good, lambda d: d.dropFields("ok"))
