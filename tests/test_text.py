import pytest
from pyspark.sql import functions as F

from codexweave.functions import hashing as H
from codexweave.functions import text as X


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column.alias("x")).first()["x"] if row else spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a, b, low, high", [("A  b", " a B ", 1, 1), ("", "  ", 1, 1), ("the sea is calm", "the sea was calm", 0.8, 0.99), ("abcdefgh", "zyxwvuts", 0, 0.2)])
def test_similarity(spark, a, b, low, high):
    assert low <= value(spark, X.similarity(F.lit(a), F.lit(b))) <= high


@pytest.mark.parametrize("text, quote, there", [("<p>One two</p><p>three</p>", "one Two", True), ("<p>One two</p><p>three</p>", "two. Three", True), ("a &amp; b c", "b, c", True), ("one two three", "two one", False), ("abc", "  ", True), ("Über die Brücke", "die brücke", True), ("one <em>two</em>", "em two", False), ("x &#8217; y", "8217", False), ("one two", "one extra two", False)])
def test_containment(spark, text, quote, there):
    assert value(spark, X.contains_quote(F.lit(text), F.lit(quote))) is there


@pytest.mark.parametrize("label, order", [("12", 12), ("247b", 247), ("xiv", -9986), ("IX", -9991), ("plate", 0), ("", 0)])
def test_page_order(spark, label, order):
    assert value(spark, X.page_order(F.lit(label))) == order


def test_excerpt(spark):
    assert value(spark, X.excerpt(F.lit(" a \n b "), 10)) == "a b"
    assert value(spark, X.excerpt(F.lit("word, word, word, word"), 12)) == "word, word…"
    assert value(spark, X.excerpt(F.lit("é" * 20), 10)) == "é" * 10 + "…"


def test_escapes_and_names(spark):
    assert value(spark, X.like_escaped(F.lit(r"50%_\x"))) == r"50\%\_\\x"
    assert value(spark, X.sort_name(F.lit("Ann B. Cole"))) == "Cole, Ann B."
    assert value(spark, X.slug(F.lit("  Größe & Maß  "))) == "groesse-mass"
    assert value(spark, X.md_to_html(F.lit("a *b* **c** ***d***"))) == "a <i>b</i> <b>c</b> <b><i>d</i></b>"
    assert value(spark, X.indent(F.lit("    x"))) == 2
    assert value(spark, X.cite_inline(F.array(F.lit("A One"), F.lit("B Two"), F.lit("C Three")), F.lit(1790), F.lit(1990))) == "One et al. [1790] 1990"
    none = F.lit(None).cast("int")
    assert value(spark, X.cite_inline(F.array(F.lit("Di Giovanni, George")), F.lit(1790), none)) == "Di Giovanni n.d."
    assert value(spark, X.cite_inline(F.array(F.lit("A One"), F.lit("B Two")), none, F.lit(1990))) == "One and Two 1990"
    assert value(spark, X.cite_inline(F.array().cast("array<string>"), none, F.lit(1990))) == "Unknown 1990"


def test_hash_encoding(spark):
    h = lambda c: value(spark, H.digest(c))
    assert h(H.optional(F.lit(None).cast("string"))) != h(H.optional(F.lit("")))
    assert h(F.concat(H.listed(F.array(F.lit("a"))), H.listed(F.array(F.lit("b"))))) != h(F.concat(H.listed(F.array(F.lit("a"), F.lit("b"))), H.listed(F.array().cast("array<string>"))))
    assert h(H.field(F.lit("a"))) == h(H.field(F.lit("a")))
