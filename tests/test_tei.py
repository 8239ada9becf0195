"""XML with milestones: events, ranges, and markdown of a small edition."""

import pyarrow as pa
import pytest
from codexweave.sources import tei

XML = """<TEI xmlns="http://x"><text><pb n="1"/><div type="contents"><head>Inhalt</head><p>weg</p></div>
<pb n="2"/><div n="1"><head>Die <hi rendition="#i">Größe</hi> der Welt.</head><p>Ein <w norm="Bewußtsein">Bewuſst-</w><lb/><w>seyn</w> und <hi rendition="#g"> weit </hi>[x] a_b hin-<lb/>und<pb n="3"/> her.</p>
<milestone unit="section"/><p>Zwei <choice><sic>felsch</sic><corr>falsch</corr></choice> <w>ur-</w><hi rendition="#in">x</hi> Selb<hi rendition="#i">ſt</hi>s<fw>Bogen</fw> <supplied>da</supplied></p><milestone unit="section"/><pb n="4"/>
<lg><l>Erste Zeile</l><l>zweite<lb/>Zeile</l></lg><p> </p><milestone unit="section"/>
<pb n="V"/><div n="2"><head/><p>Bew<w norm="los">uſst-<lb/>los</w>igkeit <w norm="ganzes">gan-</w><lb/><pb n="6"/><w>zes</w> Wort</p></div></div></text></TEI>"""


@pytest.fixture(scope="module")
def found(spark):
    return tei.events(spark.createDataFrame([("a", XML), ("b", ""), ("c", None), ("d", "<t><div><p>nur</p></div></t>")], "file string, xml string")).cache()


def test_nodes(found):
    rows = [tuple(r)[2:] for r in tei.nodes(found.filter("file = 'a'")).orderBy("position").collect()]
    assert rows == [(1, 1, "2", "1 2", "Die Größe der Welt", "die_groesse_der_welt"), (2, 2, "V", "V", "Einleitung", "einleitung")]


def test_blocks(found):
    rows = tei.blocks(found).orderBy("file", "div", "position").collect()
    assert [(r["file"], r["position"], r["md"]) for r in rows] == [
        ("a", 0, "Ein Bewuſstseyn und ***weit*** \\[x] a\\_b hin-und {{{ 3 }}} her."), ("a", 1, "---"),
        ("a", 2, "Zwei felsch ur-x Selb<i>ſt</i>s [da]"), ("a", 3, "---"), ("a", 4, "| {{{ 4 }}} Erste Zeile\n| zweite Zeile"),
        ("a", 0, "Bewuſstlosigkeit ganzes {{{ 6 }}} Wort"), ("d", 0, "nur"),
    ]
    modern = tei.blocks(found, "corr").filter("md LIKE 'Zwei%'").first()["md"]
    assert modern.startswith("Zwei falsch")


def test_ranges(found):
    at = tei.placed(found.filter("file = 'a'"))
    text = "".join(r["text"] for r in at.filter("kind = 'text'").orderBy("n").collect())
    pages = {r["label"]: text[r["start"] : r["stop"]] for r in tei.milestone_ranges(at, "pb").collect()}
    assert pages["3"].startswith(" her.") and pages["3"].rstrip().endswith("da") and pages["6"].startswith("zes Wort") and "".join(pages[k] for k in ("1", "2", "3", "4", "V", "6")) == text
    ranges = sorted((r["start"], r["stop"]) for r in tei.element_ranges(at, "p").collect())
    assert [text[a:b] for a, b in ranges][:2] == ["weg", "Ein Bewuſst-seyn und  weit [x] a_b hin-und her."]
    divs = sorted((r["start"], r["stop"]) for r in tei.element_ranges(at, "div").collect())
    assert divs[1][0] <= divs[2][0] <= divs[2][1] <= divs[1][1]
    assert tei.milestone_ranges(at, "milestone", "section").count() == 3


def test_no_xml(spark):
    with pytest.raises(Exception, match="mismatched|not well|no element|tag"):
        tei.events(spark.createDataFrame([("x", "<a><b></a>")], "file string, xml string")).collect()


def test_placed_events_are_read_from_a_table(found):
    """Ranges of every kind read what was written once, so that no range parses the files again."""
    at = tei.placed(found)
    both = tei.milestone_ranges(at, "pb").join(tei.element_ranges(at, "p"), "file")
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "UDTF" not in plan and "InMemoryRelation" not in plan and at.inputFiles()


def test_events_in_batches(monkeypatch):
    """Files keep their events, whatever fits into a batch; sources without any stand between them."""
    sources = [None, "<a x='1'>ä<b/></a>", "", XML, "<a/>", None, "<t y='2' z=''>x</t>", ""]
    schema = pa.schema([("file", pa.int64()), ("n", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("path", pa.list_(pa.struct([("id", pa.int32()), ("name", pa.string())])))])
    batch = pa.record_batch([pa.array(range(8), pa.int64()), pa.array(sources)], names=["file", "xml"])
    expected = [(i, n, kind, name, attrs, text, path) for i, s in enumerate(sources) if s for n, kind, name, attrs, text, path in tei.read_events(s)]
    for most in (1, 7, 20_000):
        monkeypatch.setattr(tei, "AT_ONCE", most)
        rows = [r for b in tei._events(iter([batch]), schema) for r in b.to_pylist()]
        got = [(r["file"], r["n"], r["kind"], r["name"], None if r["attrs"] is None else dict(r["attrs"]), r["text"], [(x["id"], x["name"]) for x in r["path"]]) for r in rows]
        assert got == expected
