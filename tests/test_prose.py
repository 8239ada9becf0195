"""Curated prose: blocks by the table function, and sentences with all that hangs on them."""

import pytest
from codexweave.functions.sentences import RUN
from codexweave.sources import blocks, prose

BODY = """## {{{ 7 }}} {{ VII }} Vorrede

Erster Satz[^*]. Er {{{ 8 }}} geht {{ IX }} _weiter_.
Noch in der Zeile. |||doch neu
+ 1) Eins. Ja.
+ 2) Zwei{{$m `Rand. Note.`}} hier.

---
[^*]: Note eins. Mit {{{ 9 }}} Zeile
weiter. Ende.
[^**]: Zweite.

<figure>
  <figcaption>{{{ 87 }}} Tafel der <b>Urtheile</b></figcaption>
  <table><tr><td>x</td></tr></table>
</figure>

***
Schluß ***sperr*** und <i>a</i>b[^**] {{$m `Zwei`}} Ende[^?].
## Neu
"""


def frame(spark, rows):
    return spark.createDataFrame(rows, "book string, file int, language string, body string")


def test_blocks(spark):
    found = blocks.blocks(frame(spark, [("k", 1, "de", BODY), ("k", 2, "de", None), ("k", 3, "de", "\n \n")])).orderBy("position").collect()
    assert [(r["kind"], r["marker"]) for r in found] == [("heading", None), ("paragraph", None), ("separator", "---"), ("footnote", "*"), ("footnote", "**"), ("figure", None), ("separator", "***"), ("paragraph", None), ("heading", None)]
    assert found[1]["text"] == f"Erster Satz[^*]. Er {{{{{{ 8 }}}}}} geht {{{{ IX }}}} _weiter_. Noch in der Zeile. |||doch neu {RUN}1) Eins. Ja. {RUN}2) Zwei{{{{$m `Rand. Note.`}}}} hier."
    assert found[3]["text"] == "Note eins. Mit Zeile weiter. Ende." and [tuple(m) for m in found[3]["markers"]] == [("page", "9", 15)]
    assert "<table>" in found[5]["text"] and "{{{" not in found[5]["text"] and [tuple(m)[:2] for m in found[5]["markers"]] == [("page", "87")]


@pytest.mark.parametrize(("body", "kinds"), [
    ("First.\n\n---\n\nSecond.\n\n***\n\nThird.\n", ["paragraph", "separator", "paragraph", "separator", "paragraph"]),
    ("This has ***emphasis*** inside.\n", ["paragraph"]),
    ("## A\n\n***\n\nBody.\n[^a]: n\n[^b]: m\n## B", ["heading", "separator", "paragraph", "footnote", "footnote"]),
    ("[^a]: n\n## B", ["footnote"]),
    ("<figure>never closed\nmore", ["figure"]),
    ("+ 1) Only item.\r\n+ 2) Next", ["paragraph"]),
    ("", []),
])
def test_block_kinds(body, kinds):
    assert [k for k, *_ in blocks.parsed(body)] == kinds


def test_marks():
    assert blocks.lifted("{{{ 7 }}} {{ VII }} Vorrede") == ("Vorrede", [("page", "7", 0), ("edition", "VII", 0)])
    assert blocks.lifted("text before {{ XIV }} text after") == ("text before text after", [("edition", "XIV", 12)])
    assert blocks.lifted("APPETITE; {{$m 7}} and {{{247b}}}") == ("APPETITE; and ", [("margin", "7", 10), ("page", "247b", 14)])
    with pytest.raises(ValueError, match="margin"):
        blocks.lifted("some {{$m `Memory.`}} more")


def test_sentences(spark):
    rows = prose.sentences(frame(spark, [("k", 1, "de", "Eins. Zwei. {{$m `Vor`}}\n"), ("k", 2, "de", BODY), ("other", 1, "de", "Allein[^*].\n[^*]: Dort.")]), "Abbildung").collect()
    got = {(r["book"], r["file"], r["block"], r["position"]): r for r in rows}
    texts = [got[k]["text"] for k in sorted(got) if k[:2] == ("k", 2)]
    assert texts == ["Vorrede", "Erster Satz.", "Er geht weiter.", "Noch in der Zeile.", "doch neu", "1) Eins.", "Ja.", "2) Zweihier.", "", "Tafel der Urtheile", "", "Schluß sperr und ab Ende.", "Neu"]
    para = [got["k", 2, 1, i] for i in range(7)]
    assert [r["segment"] for r in para] == [None, None, None, None, 1, 1, 2]
    assert [r["sentence_number"] for r in para] == list(range(3, 10)) and {r["block_number"] for r in para} == {2}
    assert [[tuple(m) for m in r["markers"]] for r in para] == [[], [("page", "8", 8, 3), ("edition", "IX", 9, 8)], [], [], [], [], []]
    assert para[0]["html"] == "Erster Satz<sup>1</sup>." and para[0]["footnotes"] == [1] and para[1]["html"] == 'Er geht <span class="antiqua">weiter</span>.'
    assert [(n["number"], [s["text"] for s in n["sentences"]]) for n in para[6]["margin_notes"]] == [(2, ["Rand.", "Note."])]
    head = got["k", 2, 0, 0]
    assert [tuple(m) for m in head["markers"]] == [("page", "7", 7, 0), ("edition", "VII", 7, 0)] and head["sentence_number"] is None
    assert got["k", 2, 3, 0]["html"].count("<figcaption><b>Abbildung 1.</b> Tafel der <b>Urtheile</b></figcaption>") == 1 and got["k", 2, 3, 0]["block_number"] == 1
    assert (got["k", 2, 2, 0]["html"], got["k", 2, 4, 0]["html"]) == ("rule", "dinkus")
    last = got["k", 2, 5, 0]
    assert last["footnotes"] == [2] and last["sentence_number"] == 10 and [n["number"] for n in last["margin_notes"]] == [3]
    assert last["html"] == 'Schluß <span class="sperrdruck">sperr</span> und <span class="antiqua">a</span>b<sup>2</sup> Ende<sup>?</sup>.'
    assert got["other", 1, 0, 0]["footnotes"] == [1]
    notes = {(r["book"], r["number"]): r for r in prose.footnotes(frame(spark, [("k", 2, "de", BODY), ("other", 1, "de", "Allein[^*].\n[^*]: Dort.")])).collect()}
    assert [s["text"] for s in notes["k", 1]["sentences"]] == ["Note eins.", "Mit Zeile weiter.", "Ende."] and notes["other", 1]["marker"] == "*"


@pytest.mark.parametrize("body", ["A {{$m `open}} b.", "<figure><table></table></figure>"])
def test_refused(spark, body):
    with pytest.raises(Exception, match="margin|caption"):
        prose.sentences(frame(spark, [("k", 1, "en", body)])).collect()


def test_blocks_are_cut_once(spark):
    """What reads sentences finds them cut: no rule of a splitter is left in its plan, so none runs again for counts or numbers."""
    found = prose.sentences(frame(spark, [("k", 1, "de", "Eins. Zwei.\n\nDrei."), ("k", 2, "de", "+ Vier. Fünf.")]))
    assert "Hauptst" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["text"], r["sentence_number"], r["segment"]) for r in found.orderBy("file", "block", "position").collect()] == [("Eins.", 1, None), ("Zwei.", 2, None), ("Drei.", 3, None), ("Vier.", 4, 1), ("Fünf.", 5, 1)]
