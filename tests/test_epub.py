"""EPUB: package metadata, contents, and sections cut at anchors."""

import zipfile

from codexweave.sources import epub, tei
from pyspark.sql import functions as F

OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"><metadata><dc:title>Kritik</dc:title>
<dc:creator opf:role="edt">Ed</dc:creator><dc:creator opf:role="aut">Immanuel</dc:creator><dc:language>de</dc:language><dc:date>1787</dc:date></metadata></package>"""
NCX = """<ncx xmlns="http://x"><docTitle><text>Kritik</text></docTitle><navMap><navPoint id="a" playOrder="1"><navLabel><text>Eins</text></navLabel><content src="one.html"/>
<navPoint id="b" playOrder="2"><navLabel><text>Zwei</text></navLabel><content src="two.html#s2"/><navPoint id="c" playOrder="3"><navLabel><text>Drei</text></navLabel><content src="two.html#s3"/></navPoint></navPoint></navPoint>
<navPoint id="d" playOrder="4"><navLabel><text>Vier</text></navLabel><content src="two.html#none"/></navPoint><navPoint id="e" playOrder="5"><navLabel><text>Drei b</text></navLabel><content src="three.html"/></navPoint><navPoint id="f" playOrder="6"><navLabel><text>F</text></navLabel><content src="three.html#x"/></navPoint></navMap></ncx>"""
ONE = """<html><body><h1>Titel</h1><p>Ein <i>kurzer</i> Satz.<a class="page" href="#">[83]</a> <span>Noch</span> einer.</p><p id="x"></p><div class="emptyLine"/><p class="fn">Fußnoten</p><p>Note <b>eins</b></p><h2>weg</h2><p> </p></body></html>"""
TWO = """<html><body><p>davor</p><h2 id="s2">Zwei</h2><p>im zweiten</p><p class="fn">Fußnoten:</p><p>Note zwei</p><p><a id="s3"/>dritter</p><table><tr><td>a</td></tr></table></body></html>"""
THREE = """<html><body><p id="anthree">Erstes</p><p class="fn">nicht</p><h3 id="x">X</h3></body></html>"""


def test_metadata(spark):
    rows = spark.createDataFrame([(1, OPF), (2, "<package><metadata><creator>Only</creator></metadata></package>"), (3, OPF.replace("aut", "trl"))], "k int, x string").select("k", epub.metadata(F.col("x")).alias("m")).select("k", "m.*").orderBy("k").collect()
    assert [tuple(r)[1:] for r in rows] == [("Kritik", "Immanuel", "de", "", "1787"), ("", "Only", "", "", ""), ("Kritik", "Ed", "de", "", "1787")]


def test_contents(spark):
    rows = epub.nav_points(tei.events(spark.createDataFrame([("k", NCX)], "file string, xml string"))).orderBy("place").collect()
    assert [(r["id"], r["play_order"], r["depth"], r["label"], r["member"], r["fragment"], r["parent"]) for r in rows] == [
        ("a", 1, 1, "Eins", "one.html", None, None), ("b", 2, 2, "Zwei", "two.html", "s2", "a"), ("c", 3, 3, "Drei", "two.html", "s3", "b"),
        ("d", 4, 1, "Vier", "two.html", "none", None), ("e", 5, 1, "Drei b", "three.html", None, None), ("f", 6, 1, "F", "three.html", "x", None),
    ]


def test_book(spark, tmp_path):
    ncx = NCX.replace('<navPoint id="d" playOrder="4"><navLabel><text>Vier</text></navLabel><content src="two.html#none"/></navPoint>', "")
    with zipfile.ZipFile(tmp_path / "k.epub", "w") as z:
        for name, text in (("OPS/c.opf", OPF), ("OPS/toc.ncx", ncx), ("OPS/one.html", ONE), ("OPS/two.html", TWO), ("OPS/three.html", THREE), ("cover.jpg", "x")):
            z.writestr(name, text)
    found = epub.members(spark, str(tmp_path))
    rows = epub.book(found).orderBy("place", "position").collect()
    assert [(r["id"], r["position"], r["kind"], r["text"], r["paragraph_number"]) for r in rows] == [
        ("a", 0, "heading", "Titel", None), ("a", 1, "paragraph", "Ein kurzer Satz. Noch einer.", 1), ("a", 2, "separator", "", None), ("a", 3, "footnote", "Note eins", None),
        ("b", 0, "heading", "Zwei", None), ("b", 1, "paragraph", "im zweiten", 2), ("b", 2, "footnote", "Note zwei", None), ("c", 0, "paragraph", "dritter", 3), ("c", 1, "paragraph", "a", 4),
        ("e", 0, "paragraph", "Erstes", 5), ("f", 0, "heading", "X", None),
    ]
    assert rows[1]["html"] == "Ein <i>kurzer</i> Satz. Noch einer." and rows[1]["page_ref"] == "83" and rows[3]["html"] == "Note <b>eins</b>"


def test_missing_anchor(spark):
    """An anchor that is not there is the beginning; of two entries at one place the later one has the blocks."""
    elements = epub.body_elements(tei.events(spark.createDataFrame([("two.html", TWO)], "file string, xml string"))).withColumn("book", F.lit("k")).withColumnRenamed("file", "member")
    points = spark.createDataFrame([("k", "two.html", "p", 1, "none"), ("k", "two.html", "q", 2, "gone"), ("k", "two.html", "r", 3, "s3")], "book string, member string, id string, play_order int, fragment string")
    got = epub.sections(elements, points, ["book", "member"]).orderBy("id", "position").collect()
    assert [(r["id"], r["kind"], r["text"]) for r in got] == [("q", "paragraph", "davor"), ("q", "heading", "Zwei"), ("q", "paragraph", "im zweiten"), ("q", "footnote", "Note zwei"), ("r", "paragraph", "dritter"), ("r", "paragraph", "a")]


def test_body_elements_join_no_events(spark):
    """Links to pages are told within their element: two in one, one nested in a span, one without text, and none that opens around the body."""
    html = '<html><body><p>a<a class="page">[1]</a>b<a class="page">[2]</a><a href="x">c</a></p><p><span><a class="page"><i>[3]</i></a></span> d</p><p id="e">e<a class="page"/></p><a class="page">[4]</a></body></html>'
    found = epub.body_elements(tei.events(spark.createDataFrame([("f", html)], "file string, xml string")))
    assert [tuple(r) for r in found.filter("tag <> 'html'").orderBy("child").select("text", "html", "page_ref").collect()] == [("abc", "abc", "1"), ("d", "d", "3"), ("e", "e", None), ("", "", "4")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
