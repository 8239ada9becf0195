import pytest

from codexweave.operators import corpora as C

RULES = {
    "german": C.Rules(C.file_slug(C.GERMAN), C.places_without([3, 4, 9])),
    "old": C.Rules(C.file_slug(C.GERMAN | C.LONG_S), C.places_without([])),
    "english": C.Rules(C.file_slug(C.AMPERSAND), C.places_without([])),
}


def _named(spark, rows):
    found = C.named(spark.createDataFrame(rows, "corpus string, file_index int, label string, other int"), RULES)
    return [(r["sort_order"], r["source_ref"], r["slug"], r["filename"]) for r in found.orderBy("other").collect()]


def test_rules_of_each_corpus(spark):
    rows = [
        ("german", 1, "§ 2. Über  Größe", 0), ("german", 2, "ÄÖ", 1), ("german", 6, "É", 2), ("old", 0, "Die Gewiſsheit", 3),
        ("english", 1233, " Law & Right", 4), ("english", 0, "&a&b", 5), ("old", None, None, 6), ("english", 0, "", 7),
    ]
    assert _named(spark, rows) == [
        (2, "002", "2-ueber-groesse", "002_2_ueber_groesse.md"), (5, "005", "aeoe", "005_aeoe.md"), (10, "010", "", "010_.md"), (1, "001", "die-gewissheit", "001_die_gewissheit.md"),
        (1234, "1234", "law-and-right", "1234_law_and_right.md"), (1, "001", "anda-andb", "001_anda_andb.md"), (None, None, None, None), (1, "001", "", "001_.md"),
    ]


def test_unknown_corpus_fails(spark):
    with pytest.raises(Exception, match="no rules for corpus"):
        _named(spark, [("none", 0, "a", 0)])
