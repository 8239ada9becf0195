"""Phrases, slices and corrections."""

import random

import pytest
from codexweave.operators import phrases as P
from pyspark.sql import functions as F


def plain_slices(word, target, cuts):
    n, m = len(word), len(target)
    d = [[max(i, j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j - 1] + (word[i - 1] != target[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    image, i, j = {n: m}, n, m
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (word[i - 1] != target[j - 1]):
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
        image[i] = j
    at = [0, *(image[c] for c in cuts), m]
    return [target[a:b] for a, b in zip(at, at[1:])]


def test_slices(spark):
    rng = random.Random(3)
    some = [("Selbſtbewuſstseyn", "Selbstbewusstsein", [6]), ("Nothwendigkeit", "Notwendigkeit", [4]), ("abc", "", [1, 2]), ("a", "bcd", [0]), ("Daseyn", "Daseyn", [2, 4])]
    for _ in range(60):
        w, t = ("".join(rng.choice("abß") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        some.append((w, t, sorted(rng.sample(range(len(w)), min(2, len(w))))))
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(some)], "i int, w string, t string, c array<int>").select("i", P.slices(F.col("w"), F.col("t"), F.col("c")).alias("p")).collect()
    for r in rows:
        assert r["p"] == plain_slices(*some[r["i"]])
    assert {r["i"]: r["p"] for r in rows}[0] == ["Selbst", "bewusstsein"]


def test_phrases(spark):
    texts = [(1, "a b c d a b a".split()), (2, "x a b c".split()), (3, []), (4, ["c"]), (5, None)]
    known = ["a b", "a b c", "c d a", "b", "q", "c"]
    got = sorted(tuple(r) for r in P.phrase_matches(spark.createDataFrame(texts, "k int, w array<string>"), "k", "w", spark.createDataFrame([(x,) for x in [*known, "a b"]], "p string"), "p").collect())
    assert got == [(1, 0, 3, "a b c"), (1, 4, 2, "a b"), (2, 1, 3, "a b c"), (4, 0, 1, "c")]


@pytest.mark.parametrize("empty", [False, True])
def test_corrections(spark, empty):
    texts = spark.createDataFrame([("f", "one two two three"), ("g", "x"), ("h", None)], "file string, text string")
    ops = [("f", 1, "one", "two"), ("f", 2, "two", "2"), ("f", 3, "three", "3 one"), ("f", 4, "one", "1"), ("f", 5, "", "z"), ("none", 1, "a", "b")]
    df = spark.createDataFrame([] if empty else ops, "file string, number int, search string, replace string")
    got = {r["file"]: (r["text"], r["refused"]) for r in P.corrected(texts, df, "file", "text").collect()}
    assert got == {"f": ("one two two three", []) if empty else ("two two two 3 1", [2, 5]), "g": ("x", []), "h": (None, [])}


def test_outline(spark):
    from codexweave.operators import hierarchy as T

    rows = [(1, None, 0), (2, 1, 5), (3, 1, 2), (4, 3, 9), (5, 3, 9), (6, 99, 0)] + [(k, k - 1, 0) for k in range(101, 160)] + [(100, None, 0)]
    got = {r["n"]: r for r in T.outline(spark.createDataFrame(rows, "n int, p int, o int"), "n", "p", "o").collect()}
    assert [n for n in sorted(got, key=lambda n: (got[n]["root"], got[n]["place"])) if got[n]["root"] in (1, 6)] == [1, 3, 4, 5, 2, 6]
    assert got[1]["children"] == [3, 2] and got[3]["children"] == [4, 5] and got[6]["children"] == [] and got[4]["level"] == 3
    assert got[159]["level"] == 60 and got[159]["root"] == 100 and got[159]["place"] == 59 and len(got[159]["path"]) == 60
    with pytest.raises(ValueError, match="cycle"):
        T.outline(spark.createDataFrame([(1, None, 0), (2, 3, 0), (3, 2, 0)], "n int, p int, o int"), "n", "p", "o")
    assert T.outline(spark.createDataFrame([], "n int, p int, o int"), "n", "p", "o").count() == 0


def test_passages(spark):
    from codexweave.operators import passages as G

    key = "work string, source_ref string, ref_value string"
    known = spark.createDataFrame([("w", "a", "1", 9), ("w", "z", "1", 4)], f"{key}, ordinal long")
    verses = spark.createDataFrame([("w", "a", "2", 7), ("w", "a", "1", 3), ("w", "a", "2", 5), ("v", "a", "1", 8)], f"{key}, number int")
    minted = G.minted(known, verses)
    assert sorted(tuple(r) for r in minted.collect()) == [("v", "a", "1", 1), ("w", "a", "1", 1), ("w", "a", "2", 2), ("w", "z", "1", 4)]
    sentences = spark.createDataFrame([(1, "k", "w", "a", "1", 1), (2, "k", "w", "a", "2", None), (3, "m", "w", "a", "1", 1), (4, "m", "w", "a", "2", 2), (5, "k", None, "a", "1", None)], f"sentence int, book string, {key}, ordinal long")
    aligned = spark.createDataFrame([("m", "a", "1", "a", "2"), ("m", "a", "2", None, None)], "book string, source_ref string, ref_value string, canonical_source_ref string, canonical_ref_value string")
    assert sorted(tuple(r) for r in G.stamped(sentences, aligned, minted).collect()) == [(2, 2), (3, 2), (4, None)]
    old = spark.createDataFrame([("x", 1, "body", 10, None), ("y", 1, "body", 11, 12)], "article string, book int, kind string, start int, stop int")
    saved = spark.createDataFrame([("x",), ("x",), ("new",)], "article string")
    directives = spark.createDataFrame([("x", "one", "body", 1, 2), ("x", "one", "body", 1, 2), ("x", "one", "body", 1, 99), ("x", "gone", "body", 1, None), ("new", "one", "body", 2, None), ("y", "one", "body", 1, None)], "article string, slug string, kind string, first int, last int")
    books = spark.createDataFrame([("one", 1)], "slug string, book int")
    places = spark.createDataFrame([(101, 1, "body", 1), (102, 1, "body", 2)], "sentence int, book int, kind string, number int")
    assert sorted(map(str, G.resynced(old, saved, directives, books, places).collect())) == sorted(map(str, [*old.filter("article = 'y'").collect(), *spark.createDataFrame([("x", 1, "body", 101, 102), ("new", 1, "body", 102, None)], old.schema).collect()]))
