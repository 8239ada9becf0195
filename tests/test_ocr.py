"""Scanned pages: a response to lines, zones, elements, notes and stitched text."""

import json

import pytest
from codexweave.sources import ocr
from pyspark.sql import functions as F

TEXT = "Kritik\n10 Ein Anfang der Ver-\nnunft ist da.*)\nNeuer Absatz hier²)\nweiter 15\n15\n*) Note eins\nzweite Zeile\n2) Andere An-\n"
PLACES = [(0.3, 0.05), (0.1, 0.2), (0.1, 0.22), (0.14, 0.24), (0.1, 0.26), (0.9, 0.28), (0.1, 0.8), (0.1, 0.82), (0.1, 0.84)]
ENDS = [i + 1 for i, c in enumerate(TEXT) if c == "\n"]
AT = [(a, b, *place) for a, b, place in zip([0, *ENDS], ENDS, PLACES)]


def response(as_text=True):
    lines = [{"layout": {"textAnchor": {"textSegments": [{"startIndex": str(a) if as_text else a, "endIndex": str(b) if as_text else b} if a else {"endIndex": b}]}, "boundingPoly": {"normalizedVertices": [{"x": x, "y": y}, {"x": x + 0.3, "y": y + 0.01}]}}} for a, b, x, y in AT]
    lines += [{"layout": {"textAnchor": {}}}, {"layout": {"textAnchor": {"textSegments": [{"startIndex": 0, "endIndex": 3}]}}}]
    return json.dumps({"text": TEXT, "pages": [{"dimension": {"width": 1000, "height": 2000}, "lines": lines}]})


@pytest.fixture(scope="module")
def found(spark):
    rows = [(2, response()), (4, response(False)), (5, "{}"), (6, None), (7, json.dumps({"text": "x", "pages": []}))]
    return ocr.lines(spark.createDataFrame(rows, "page int, response string")).cache()


def test_lines(found):
    rows = found.orderBy("page", "n").collect()
    assert [r["text"] for r in rows if r["page"] == 2] == TEXT.split("\n")[:-1] == [r["text"] for r in rows if r["page"] == 4]
    assert {r["page"] for r in rows} == {2, 4} and (round(rows[1]["x"]), round(rows[1]["y"]), round(rows[1]["width"]), round(rows[1]["height"])) == (100, 400, 300, 20)


def test_line_numbers(spark, found):
    got = {r["text"]: r["line_number"] for r in ocr.without_line_numbers(found.filter("page = 2")).collect()}
    assert got["Ein Anfang der Ver-"] == 10 and "15" not in got and got["weiter 15"] is None
    odd = {r["text"]: r["line_number"] for r in ocr.without_line_numbers(found.filter("page = 2").withColumn("page", F.lit(3))).collect()}
    assert odd["weiter"] == 15 and odd["10 Ein Anfang der Ver-"] is None


def test_page(found):
    lines = ocr.zoned(ocr.without_line_numbers(found.filter("page = 2")), height=2000.0)
    assert [r["zone"] for r in lines.orderBy("n").collect()] == ["header", "body", "body", "body", "body", "notes", "notes", "notes"]
    assert [r["place"] for r in ocr.columned(lines).orderBy("n").collect()] == list(range(8))
    rows = ocr.elements(lines).orderBy("element").collect()
    assert [(r["kind"], r["lines"]) for r in rows] == [("heading", ["Ein Anfang der Ver-", "nunft ist da.*)"]), ("heading", ["Neuer Absatz hier²)", "weiter 15"])]
    assert [r["markers"] for r in rows] == [["*"], ["2"]]
    assert [(r["marker"], r["text"]) for r in ocr.notes(lines).orderBy("place").collect()] == [("*", "Note eins zweite Zeile"), ("2", "Andere An-")]


def test_columns(spark):
    rows = [(1, "body", i, x, y, 200.0) for i, (x, y) in enumerate([(100.0, 10.0), (400.0, 5.0), (110.0, 30.0), (395.0, 40.0)])]
    got = ocr.columned(spark.createDataFrame(rows, "page int, zone string, n int, x double, y double, width double")).orderBy("place").collect()
    assert [(r["column"], r["n"]) for r in got] == [(0, 0), (0, 2), (1, 1), (1, 3)]


def test_stitching(spark):
    rows = [("b", 1, 0, ["Alpha be-", "", "ta", "gam-"]), ("b", 2, 0, ["ma delta", "eps-"]), ("b", 3, 0, ["ilon"]), ("b", 3, 1, ["end-"]), ("b", 3, 2, ["stay"]), ("c", 1, 0, ["last-"])]
    got = ocr.across_pages(spark.createDataFrame(rows, "book string, page int, element int, lines array<string>"), ["book"]).orderBy("book", "page", "element").collect()
    assert [r["stitched"] for r in got] == ["Alpha beta gamma", "delta epsilon", "", "end-", "stay", "last-"]


def test_marks(spark):
    rows = [("s", 1, "*"), ("s", 2, "*"), ("s", 3, "1"), ("s", 4, "2"), ("s", 5, "1"), ("s", 6, "a"), ("t", 1, "1")]
    got = {(r["k"], r["n"]): r["mark"] for r in ocr.remapped(spark.createDataFrame(rows, "k string, n int, marker string"), ["k"], ["n"]).collect()}
    assert [got["s", i] for i in range(1, 7)] == ["*", "**", "1", "2", "3", "a"] and got["t", 1] == "1"
    text = spark.range(1).select(ocr.referred(F.lit("a¹) b*) c**) (5) d2)"), F.create_map(F.lit("1"), F.lit("7"), F.lit("*"), F.lit("**"))).alias("t")).first()["t"]
    assert text == "a[^7] b[^**] c**) (5) d2)"
    assert spark.range(1).select(ocr.cleaned(F.lit('"x „a „b" c" \\\') \\") „open')).alias("t")).first()["t"] == 'x „a „b" c ) ) „open'
    entries = spark.createDataFrame([("s", 2, 0), ("s", 2, 1), ("s", 5, 2)], "k string, page int, entry int")
    pages = spark.createDataFrame([("s", p) for p in (1, 2, 4, 5, 9)], "k string, page int")
    assert [r["section"] for r in ocr.sections(pages, entries, ["k"]).orderBy("page").collect()] == [0, 1, 1, 2, 2]
