import re

from codexweave.operators import nodepages as N
from codexweave.plans import editions
from codexweave.plans.tables import Tables
from oracle import FOLDER


def _nodes(spark):
    return spark.createDataFrame([("b", f"n{i}", i * 10) for i in range(1, 6)] + [("c", "m0", 0)], "book string, node string, sort_order int")


def _held(spark, original=False):
    blocks = spark.createDataFrame([("n2", "x", 1, 7, "<o>"), ("n2", "w", 0, None, "<p>"), (None, "lost", 0, None, None)], "node string, block string, position int, figure_number int, original_html string")
    sentences = spark.createDataFrame([("x", "s1", 0, "t1"), ("w", "s3", 1, "t3"), ("w", "s2", 0, "t2"), (None, "s9", 0, "t9")], "block string, sentence string, position int, original_text string")
    markers = spark.createDataFrame([("s2", 5, "aa"), ("s2", 3, "ed"), (None, 1, "aa")], "sentence string, sort_order int, system string")
    heads = spark.createDataFrame([("s3", "f2", 2), ("s3", "f1", 1)], "sentence string, note string, number int")
    bodies = spark.createDataFrame([("f1", 1, "b"), ("f1", 0, "a")], "note string, position int, original_text string")
    return N.contents(blocks, sentences, markers, {"footnotes": (heads, bodies), "margin_notes": (heads.limit(0), bodies.limit(0))}, original)


def test_contents_whole(spark):
    (row,) = _held(spark, True).collect()
    w, x = row["blocks"]
    assert row["node"] == "n2" and [w["block"], x["block"]] == ["w", "x"] and x["original_html"] == "<o>"
    assert [s["sentence"] for s in w["sentences"]] == ["s2", "s3"] and x["sentences"][0]["figure_number"] == 7 and w["sentences"][0]["figure_number"] is None
    assert [m["sort_order"] for m in w["sentences"][0]["markers"]] == [3, 5] and w["sentences"][1]["markers"] == []
    f1, f2 = w["sentences"][1]["footnotes"]
    assert (f1["note"], f2["note"], f2["sentences"]) == ("f1", "f2", []) and [b["original_text"] for b in f1["sentences"]] == ["a", "b"]
    assert all(s["margin_notes"] == [] for b in (w, x) for s in b["sentences"])


def test_contents_within_their_node_are_shuffled_once(spark):
    """Dealt by node, no level is shuffled again, and the contents are as without."""
    held = editions._held(Tables(spark, FOLDER))
    shuffles = re.findall(r"Exchange (hashpartitioning\(.*?), \d+\)", held._jdf.queryExecution().sparkPlan().toString() + held._jdf.queryExecution().executedPlan().toString())
    assert shuffles and all(re.fullmatch(r"hashpartitioning\(node#\d+L?", x) for x in shuffles)
    blocks = spark.createDataFrame([("n", "x", 1, 7), ("n", "w", 0, None), ("m", "v", 0, None)], "node string, block string, position int, figure_number int")
    sentences = spark.createDataFrame([("n", "x", "s1", 0), ("n", "w", "s3", 1), ("n", "w", "s2", 0), ("n", None, "s9", 0)], "node string, block string, sentence string, position int")
    markers = spark.createDataFrame([("n", "s2", 5), ("n", "s2", 3)], "node string, sentence string, sort_order int")
    heads = spark.createDataFrame([("n", "s3", "f2", 2), ("n", "s3", "f1", 1)], "node string, sentence string, note string, number int")
    bodies = spark.createDataFrame([("n", "f1", 1), ("n", "f1", 0)], "node string, note string, position int")
    told = N.contents(blocks, sentences, markers, {"footnotes": (heads, bodies)}, within="node")
    bare = N.contents(blocks, *(x.drop("node") for x in (sentences, markers)), {"footnotes": (heads.drop("node"), bodies.drop("node"))})
    assert sorted(told.collect()) == sorted(bare.collect())


def test_originals_only_if_asked_for(spark):
    (row,) = _held(spark).collect()
    for b in row["blocks"]:
        assert b["original_html"] is None and all(s["original_text"] is None and all(x["original_text"] is None for f in s["footnotes"] for x in f["sentences"]) for s in b["sentences"])


def test_pages_both_ways(spark):
    asked = [
        ("start", "b", None, None, 2), ("after", "b", 20, None, 2), ("between", "b", 25, None, 2), ("end", "b", 40, None, 2), ("past", "b", 50, None, 2),
        ("back", "b", None, 40, 2), ("back_first", "b", None, 20, 2), ("back_none", "b", None, 10, 2), ("both", "b", 10, 50, 2), ("zero", "c", None, None, 2), ("no_book", "z", None, None, 2),
    ]
    requests = spark.createDataFrame(asked, "request string, book string, after int, before int, size int")
    found = {r["request"]: ([n["node"] for n in r["nodes"]], r["has_more"], r["has_previous"]) for r in N.pages(requests, _nodes(spark), _held(spark)).collect()}
    assert found == {
        "start": (["n1", "n2"], True, True), "after": (["n3", "n4"], True, True), "between": (["n3", "n4"], True, True), "end": (["n5"], False, True), "past": ([], False, False),
        "back": (["n2", "n3"], True, True), "back_first": (["n1"], True, False), "back_none": ([], False, False), "both": (["n3", "n4"], True, True), "zero": (["m0"], False, False), "no_book": ([], False, False),
    }


def test_page_carries_contents(spark):
    requests = spark.createDataFrame([("r", "b", 10, None, 2)], "request string, book string, after int, before int, size int")
    (row,) = N.pages(requests, _nodes(spark), _held(spark)).collect()
    assert [(n["node"], len(n["blocks"])) for n in row["nodes"]] == [("n2", 2), ("n3", 0)]


def test_empty_tables(spark):
    requests = spark.createDataFrame([("r", "b", None, None, 2)], "request string, book string, after int, before int, size int")
    (row,) = N.pages(requests, _nodes(spark).limit(0), _held(spark).limit(0)).collect()
    assert (row["nodes"], row["has_more"], row["has_previous"]) == ([], False, False)
    assert N.pages(requests.limit(0), _nodes(spark), _held(spark)).count() == 0
