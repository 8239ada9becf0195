"""Splitters against their rules, case by case and by a plain version over whole texts."""

import re

import pytest
from codexweave.functions import sentences as S
from oracle import FOLDER
from pyspark.sql import functions as F

CASES = [
    ("de", "Es ist d. i. dasselbe. Nächster Satz.", ["Es ist d. i. dasselbe.", "Nächster Satz."]),
    ("de", "Etwas z. B. Hier. Dann weiter.", ["Etwas z. B. Hier.", "Dann weiter."]),
    ("de", "Etwas z.B. Hier. Dann weiter.", ["Etwas z.B. Hier.", "Dann weiter."]),
    ("de", "G. W. F. Hegel schrieb. Ja.", ["G. W. F. Hegel schrieb.", "Ja."]),
    ("de", "Hr. v. Saussure objektiv. Er kam.", ["Hr. v. Saussure objektiv.", "Er kam."]),
    ("de", "1. Erster Satz. 2. Zweiter.", ["1. Erster Satz. 2.", "Zweiter."]),
    ("de", "1. Erster Satz hier. Zweiter Satz dort.", ["1. Erster Satz hier.", "Zweiter Satz dort."]),
    ("de", "12. Nächster Abschnitt.", ["12. Nächster Abschnitt."]),
    ("de", "Siehe § 3. Das Ding. Gut.", ["Siehe § 3. Das Ding.", "Gut."]),
    ("de", "Sr. Excellenz, dem Königl. Staatsminister.", ["Sr. Excellenz, dem Königl. Staatsminister."]),
    ("de", "Punkte: ....., ist ein Bild. Dagegen so.", ["Punkte: ....., ist ein Bild.", "Dagegen so."]),
    ("de", "Er glaubte es. — Wir nicht.", ["Er glaubte es.", "— Wir nicht."]),
    ("de", "»Ja.« Dann kam er. »Nein!« Er ging.", ["»Ja.«", "Dann kam er.", "»Nein!«", "Er ging."]),
    ("de", "Was? es ging weiter. Gut", ["Was? es ging weiter.", "Gut"]),
    ("en", "II. On the Antithesis. Second one.", ["II. On the Antithesis.", "Second one."]),
    ("en", "Mr. Smith left. He was late.", ["Mr. Smith left.", "He was late."]),
    ("en", "See e.g. Kant or i. e. Hegel. Philosophie. That is.", ["See e.g. Kant or i. e. Hegel.", "Philosophie.", "That is."]),
    ("en", "In the 35. Chapter it is. In 28. You see.", ["In the 35. Chapter it is.", "In 28.", "You see."]),
    ("en", "He said. (Then went.) So.", ["He said.", "(Then went.)", "So."]),
    ("en", "(Cf. Dr.) A new one.", ["(Cf.", "Dr.)", "A new one."]),
    ("fr", "M. Dupont dit etc. Il part. Mr. Smith.", ["M. Dupont dit etc.", "Il part.", "Mr.", "Smith."]),
    ("en", "", []),
    (None, " One. Two. ", ["One.", "Two."]),
]


def test_rules(spark):
    rows = spark.createDataFrame([(i, g, t) for i, (g, t, _) in enumerate(CASES)], "i int, g string, t string")
    got = {r["i"]: r["s"] for r in rows.select("i", S.sentences(F.col("t"), F.col("g")).alias("s")).collect()}
    assert [got[i] for i in range(len(CASES))] == [x for *_, x in CASES]
    assert spark.createDataFrame([("en", None)], "g string, t string").select(S.sentences(F.col("t"), F.col("g")).alias("s")).first()["s"] is None


def plain(text, language, colon=False):
    """One candidate after the other, each held against the text before it."""
    singles, pairs = S.ABBREVIATIONS.get(language, []), S.PAIRS.get(language, [])
    edge, stop = (r"\b", r"\.?") if language == "en" else ("", r"\.")
    whole = [m.span() for a, b in pairs for m in re.finditer(rf"(?={edge}({a}{stop}\s*{b}\.))", text)]
    spans = [(a, a + len(re.compile(rf"(?:{'|'.join(f'{x}{stop}' + chr(92) + f's*{y}' + chr(92) + '.' for x, y in pairs)})").match(text, a)[0])) for a, _ in whole]
    found = [m.end() for m in re.finditer(r":\s+(?=[A-Z])", text)] if colon else []
    for m in re.finditer(rf"[.!?]({S.CLOSERS}*)\s+(?=(?:—\s+)?{S.OPENING})", text):
        before = text[: m.end(1)]
        no = any(before.endswith(x) for x in singles) or any(a <= m.start() < b for a, b in spans)
        no = no or re.search(r"(?:\b[A-ZÄÖÜ]\.|\A\d{1,2}\.|\A[IVXLCDM]{1,5}\.|§\s*\d{1,2}\.)$", before)
        if not (no or (re.search(r"\b\d{1,3}\.$", before) and re.match(S.ORDINAL_NOUNS, text[m.end() :]))):
            found.append(m.end())
    cuts = [0, *sorted(set(found)), len(text)]
    return [x for a, b in zip(cuts, cuts[1:]) if (x := text[a:b].strip())]


def test_whole_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text", "lang")
    noise = ["Siehe z. B. Kant. Dr. Who? I. Ja. usw. Und § 12. Aber: Dann \"Nein.\" Gut! ", "e.g. This vs. That. Mr. X. Y. cf. Z etc. Then 12. Chapter. A: But. "]
    docs = docs.union(spark.createDataFrame([(a + n * 30, g) for n in noise for g in ("de", "en", "es") for a in ("1. ", "")], "text string, lang string"))
    rows = docs.select("text", "lang", S.sentences(F.col("text"), F.col("lang")).alias("s"), S.sentences(F.col("text"), F.col("lang"), colon=True).alias("c")).collect()
    for r in rows:
        assert r["s"] == plain(r["text"], r["lang"])
        assert r["c"] == plain(r["text"], r["lang"], colon=True)


def test_verses(spark):
    rows = spark.createDataFrame([("In the beginning. And so",), ("no end",)], "t string").select(S.verses(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in rows] == [["In the beginning.", "And so"], ["no end"]]


def test_structural(spark):
    cases = {
        "a. b? c": ["a.", "b?", "c"],
        "Look. (he rises. He walks.) Now go.": ["Look.", "(he rises. He walks.) Now go."],
        "a) b. c (d (e. f) g. h) i. j": ["a) b.", "c (d (e. f) g. h) i.", "j"],
        "So… and. ": ["So…", "and."],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", S.structural(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in rows} == cases


HTML = [
    ("Eins. Zwei.", "<i>Eins. Zwei.</i>", ["<i>Eins.</i>", "<i>Zwei.</i>"]),
    ("Eins. Zwei.", '<span class="a">Eins. Zwei.</span>', ['<span class="a">Eins.</span>', '<span class="a">Zwei.</span>']),
    ("Eins. Zwei.", "Eins.<sup>10</sup> Zwei.", ["Eins.<sup>10</sup>", "Zwei."]),
    ("Ein Wort. Zwei.", "Ein<sup>11</sup> Wort. <b>Zwei.</b>", ["Ein<sup>11</sup> Wort.", "<b>Zwei.</b>"]),
    ("A a. B b.", "<b>A <i>a. B</i> b.</b>", ["<b>A <i>a.</i></b>", "<b><i>B</i> b.</b>"]),
    ("A a. B b.", "A<br/> a. <img src='x'/>B b.", ["A<br/> a.", "<img src='x'/>B b."]),
    ("One. Two.", "One.<sup>1</sup> Two.", ["One.<sup>1</sup>", "Two."]),
    ("Alles.", "<p>Alles.</p>", ["<p>Alles.</p>"]),
    ("One || two. Three.", "One || two. Three.", ["One || two.", "Three."]),
]


@pytest.mark.parametrize(("text", "html", "parts"), HTML)
def test_html(spark, text, html, parts):
    row = spark.createDataFrame([(text, html)], "t string, h string").select(S.split_html(F.col("t"), F.col("h"), F.lit("de")).alias("s")).first()["s"]
    assert [x["html"] for x in row] == parts and " ".join(x["text"] for x in row) == text


def test_forced(spark):
    text = f"erst|||das dann {S.RUN}1) eins {S.RUN}2) zwei. Drei"
    row = spark.createDataFrame([(text,)], "t string").select(S.forced(F.col("t")).alias("f")).select("f.*").first()
    assert row["text"] == text.replace("|||", "") and [row["text"][p:][:3] for p in row["positions"]] == ["das", f"{S.RUN}1)", f"{S.RUN}2)"]
    html = row["text"].replace("dann", "<i>dann</i>")
    df = spark.createDataFrame([(row["text"], html, row["positions"])], "t string, h string, p array<int>")
    got = df.select(S.split_html(F.col("t"), F.col("h"), F.lit("de"), F.col("p")).alias("s")).first()["s"]
    assert [x["text"] for x in got] == ["erst", "das dann", f"{S.RUN}1) eins", f"{S.RUN}2) zwei.", "Drei"]
    assert [x["html"] for x in got][1] == "das <i>dann</i>"
