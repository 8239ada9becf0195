import pytest
from pyspark.sql import functions as F

from codexweave.functions import citations as B
from codexweave.operators import lexicon as L
from codexweave.plans import registry
from oracle import FOLDER


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("surface, norm, expected", [("iſt", "ist", "long_s"), ("ſeyn", "sein", "ey_ei"), ("That", "Tat", "th_t"), ("Krafft", "Kraft", "ff_f"), ("Subject", "Subjekt", "c_k"), ("practiſch", "praktisch", "residual"), ("Affect", "Affekt", "c_k"), ("Theyl", "Teil", "ey_ei"), ("ſo", "ſo", "identity"), ("Haus", "Maus", "residual")])
def test_spelling_classes(spark, surface, norm, expected):
    assert value(spark, L.spelling_class(F.lit(surface), F.lit(norm))) == expected


def test_lexicon_rules_and_reports(spark):
    rows = [("ſeyn", "sein")] * 3 + [("ſeyn", "seyn")] * 2 + [("daſſ", "dass")] + [("Daſeyus", "Daseyus")] + [("wohl", "gut")] + [("am", "am")] + [("that", "tat"), ("that", "that")] + [(None, "x")]
    pairs, rulings = spark.createDataFrame(rows, "surface string, norm string"), spark.createDataFrame([("wohl", "wohl"), ("nie", "nie")], "surface string, ruling string")
    found = {r["surface"]: (r["n"], r["class"], r["result"], r["report"]) for r in L.lexicon(pairs, rulings).collect()}
    assert found["ſeyn"] == (5, "ey_ei", "sein", None)
    assert found["daſſ"] == (1, "long_s", None, "ss_audit")
    assert found["Daſeyus"] == (1, "long_s", None, "cab_unnormalized")
    assert found["wohl"] == (1, "ruling", "wohl", None)
    assert found["nie"] == (0, "ruling", "nie", None)
    assert found["am"] == (1, "identity", None, None)
    assert found["that"] == (2, "identity", None, None)  # of a tie the greatest form


def test_modernised(spark):
    entries = spark.createDataFrame([("ſeyn", "sein"), ("am", None)], "surface string, result string")
    texts = spark.createDataFrame([(1, "ſeyn, ſeyn! am-ſeyn"), (2, ""), (3, None), (4, "ſo ſeynd")], "id int, text string")
    found = {r["id"]: (r["modern"], r["keeps_long_s"]) for r in L.modernised(texts, "id", "text", entries).collect()}
    assert found == {1: ("sein, sein! am-sein", False), 2: ("", False), 3: (None, None), 4: ("ſo ſeynd", True)}


def test_a_long_text_that_is_its_own_key(spark):
    """Words travel under a digest: with their text they would be gigabytes here."""
    entries = spark.createDataFrame([("ſeyn", "sein"), ("am", None)], "surface string, result string")
    long = "ſeyn, am ſo " * 15_000
    texts = spark.createDataFrame([(long, long), ("ſo", "ſo")], "k string, text string")
    found = L.modernised(texts, "k", "text", entries)
    rows = {r["k"]: (r["modern"], r["keeps_long_s"]) for r in found.collect()}
    assert rows == {long: (long.replace("ſeyn", "sein"), True), "ſo": ("ſo", True)}
    generated = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate posexplode" in line]
    assert generated and not any("_text" in line.split("[_at", 1)[-1] for line in generated)


def _entry(spark, sort_names, names, role=None, original=None, published=1911, edition=None, place=None, publisher=None):
    some = [F.array(*map(F.lit, x)).cast("array<string>") for x in (sort_names, names)]
    rest = [F.lit(role).cast("string"), F.lit(original).cast("int"), F.lit(published).cast("int"), F.lit("T"), *[F.lit(x).cast("string") for x in (edition, place, publisher)]]
    return value(spark, B.bibliography_entry(*some, *rest))


def test_bibliography_entries(spark):
    assert _entry(spark, ["K, I"], ["I K"], original=1787, place="Riga", publisher="H") == "K, I. (1787) 1911. <em>T</em>. Riga: H."
    assert _entry(spark, ["G, D", "X, Y"], ["D G", "Y X"], role="eds.", edition=" 2nd ed ", publisher=" ") == "G, D, and Y X, eds. 1911. <em>T</em>. 2nd ed."
    assert _entry(spark, ["A, B", "C, D", "E, F"], ["B A", "D C", "F E"], published=None) == "A, B, D C, and F E. n.d. <em>T</em>."
    assert _entry(spark, [], [], original=1787, published=None, place="Riga") == "<em>T</em>. n.d. Riga."


def test_cited_together(spark):
    cited = F.array(*[F.struct(F.lit(c).alias("citation"), F.lit(p).cast("string").alias("pages")) for c, p in (("A 1900", "12"), ("B 1901", ""), ("C n.d.", None))])
    assert value(spark, B.cited_together(cited)) == "(A 1900, 12; B 1901; C n.d.)"


def test_passage_locators(spark):
    systems = F.array(*[F.struct(F.lit(t).alias("template"), F.lit(a).alias("first_ref"), F.lit(b).cast("string").alias("last_ref")) for t, a, b in (("A{ref}", "12", "14"), ("{parent} {self}, {ref}", "3", "3"), ("B {ref}", "4", None))])
    assert value(spark, B.passage_locator(systems, F.lit(None).cast("string"), F.lit("§ 1"), F.lit("s. 2"))) == "A12–14 · § 1, 3 · B 4"
    assert value(spark, B.passage_locator(F.slice(systems, 1, 0), F.lit("P"), F.lit("§ 1"), F.lit("s. 2"))) == "§ 1 · s. 2"


@pytest.mark.parametrize("body, expected", [('book="b" start=5', ("b", 5, None, "body")), ('book="b" start=9 end=4', ("b", 4, 9, "body")), ('book="b" start=4 end="4"', ("b", 4, None, "body")), ('book="b" start=7 start="8" kind="figure"', ("b", 8, None, "figure")), ('book="b" start="-2" end="x"', ("b", -2, None, "body")), ('book="" start=1', None), ("start=1", None), ('book="b"', None), ('book="b" start=99999999999', None), ('book="b" start=1 kind="note"', None)])
def test_directives(spark, body, expected):
    found = value(spark, B.quotation_directives(F.lit("x ::quotation{" + body + "} y ::quotation{} z")))
    assert [tuple(d) for d in found] == ([expected] if expected else [])


def test_no_directives(spark):
    assert value(spark, B.quotation_directives(F.lit(None).cast("string"))) is None and value(spark, B.quotation_directives(F.lit(""))) == []


def test_library(spark):
    from codexweave.operators import library as C

    rows = [
        (1, "Kritik", 1911, 1787, None, None),
        (2, "Critique", 1929, None, 1, None),
        (3, "Critica", 1950, None, 2, None),
        (4, "Works", 1920, None, None, None),
        (5, "Play", None, None, None, 4),
        (6, "Ode", 1600, None, None, 5),
        (7, "Lost", 1900, None, 99, None),
        (8, "Part", 1900, None, None, 99),
        (9, "Bible", None, None, None, None),
        (10, "Bibel", None, None, 9, None),
        (11, "Early", 1700, None, None, None),
    ]
    sources = spark.createDataFrame(rows, "source long, title string, published int, original int, translation_of long, parent long")
    hosted = [(i, i, "en" if i in (2, 9) else "de", f"b{i}") for i in (1, 2, 3, 4, 7, 8, 9, 10, 11, 77)]
    books = spark.createDataFrame(hosted, "book long, source long, language string, slug string")
    anchors = spark.createDataFrame([(4, 5, "play"), (4, 6, "ode"), (99, 6, "none")], "book long, source long, node string")
    people = [(1, "author", 1, 50, "I Kant", "Kant, I"), (1, "author", 2, 51, "A B", None), (1, "editor", 0, 52, "E", None), (11, "editor", 1, 50, "I Kant", "Kant, I"), (2, "translator", 1, 53, "T", None)]
    persons = spark.createDataFrame(people, "source long, role string, position long, person long, name string, sort_name string")
    found = {(r["kind"], r["key"]): r for r in C.library(sources, C.versions(books, anchors), persons).collect()}
    # Source 8 has an unknown parent and is left out, as is the book of unknown source 77; 7 translates an unknown source and is its own work.
    assert set(found) == {("author", 50), ("self", 4), ("self", 7), ("self", 9)}
    early, kant = found["author", 50]["works"]
    assert (early["work"], early["year"], early["co_authors"], early["editors"]) == (11, 1700, [], ["I Kant"])
    assert (kant["title"], kant["year"], kant["co_authors"], kant["editors"]) == ("Critique", 1787, ["A B"], None)
    assert [v["source"] for v in kant["versions"]] == [1, 3, 2] and found["author", 50]["sort_name"] == "Kant, I"
    assert [(w["work"], w["versions"][0]["node"]) for w in found["self", 4]["works"]] == [(6, "ode"), (5, "play")]
    assert found["self", 7]["works"] == [] and found["self", 9]["label"] == "Bible"
    assert [v["source"] for v in found["self", 9]["works"][0]["versions"]] == [9, 10]


def test_directives_are_read_once(spark):
    """One expression finds the directives and four their attributes, however often values are named."""
    found = spark.createDataFrame([('::quotation{book="b" start=3 end="2"}',)], "x string").select(B.quotation_directives(F.col("x")).alias("d"))
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 5
    assert [tuple(d) for d in found.first()["d"]] == [("b", 2, 3, "body")]


def test_library_is_not_sent_through_the_driver(spark):
    found = registry.queries()["library_catalogue"](spark, FOLDER)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 0
