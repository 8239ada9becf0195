"""Versioned tables, snapshots, runs for new contents only, and texts to write."""

import datetime

import pytest
from codexweave.operators.versions import Conflict, Files, Versions, dump, restore
from codexweave.sources import formats, sinks
from codexweave.streaming import events as E
from pyspark.sql import functions as F


def test_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    assert v.read() is None and v.latest() is None
    for k in range(4):
        assert v.commit(spark.range(k + 1), note=k) == k
    assert v.read().count() == 4 and v.read(1).count() == 2 and v.manifest(2)["note"] == 2
    with pytest.raises(Conflict):
        v.commit(spark.range(9), after=2)
    spark.range(5).write.parquet(f"file://{tmp_path}/t/data/lost")
    assert v.clean(keep=2) == 3 and v.numbers() == [2, 3] and len(v.files.names("data")) == 2
    assert v.read(2).count() == 3 and v.read().count() == 4


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    some = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        dump(spark, root, day, {"some": some, "none": some.limit(0)}, keep=2)
    found = restore(spark, root)
    assert sorted(map(str, found["some"].collect())) == sorted(map(str, some.collect())) and found["none"].count() == 0
    assert Files(spark, root).names("snapshots") == ["2024-01-02.json", "2024-01-03.json"] and len(Files(spark, root).names("data")) == 2
    with pytest.raises(Conflict):
        dump(spark, root, "2024-01-03", {"some": some})
    data = Files(spark, root).read("snapshots/2024-01-03.json")["some"]["data"]
    some.limit(2).write.mode("overwrite").parquet(f"{root}/{data}")
    with pytest.raises(RuntimeError, match="differs"):
        restore(spark, root)


def test_new_contents(spark, tmp_path):
    built, folder = [], tmp_path / "in"
    folder.mkdir()

    def go():
        E.new_artefacts(spark, str(folder), f"file://{tmp_path}/state", lambda df, n: built.append(sorted(r["path"].rpartition("/")[2] for r in df.collect())), str(tmp_path / "c")).awaitTermination()

    (folder / "a.json").write_text("1")
    (folder / "b.json").write_text("1")
    (folder / "skip.txt").write_text("9")
    go()
    (folder / "c.json").write_text("1")
    go()
    (folder / "d.json").write_text("2")
    go()
    go()
    assert built == [["a.json"], ["d.json"]]


def test_refreshing(spark, tmp_path):
    seen = []
    apply = E.refreshing(f"file://{tmp_path}/h", "k", "v", lambda df, n: seen.append((n, sorted(r["k"] for r in df.collect()))))
    first, second = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, v string")
    apply(first, 0)
    apply(first, 0)
    apply(second, 1)
    apply(second, 2)
    assert seen == [(0, [1, 2]), (1, [2, 3]), (2, [])] and len(Versions(spark, f"file://{tmp_path}/h").numbers()) == 2


def test_artefact_hash(spark, tmp_path):
    hashes = []
    for names in (("x/a", "y/a"), ("x/a", "z/a"), ("x/a", "y/a")):
        base = tmp_path / f"f{len(hashes)}"
        for i, n in enumerate(names):
            (base / n).parent.mkdir(parents=True)
            (base / n).write_text(str(i))
        hashes.append(formats.artefact_hash(spark, str(base)).first()["artefact"])
    assert hashes[0] == hashes[2] != hashes[1]


def test_markdown_files(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 4, "ein-a", 'Ein "A"', 2, 7), (2, 5, "leer", "Leer", 1, 9)], "node int, position int, slug string, label string, depth int, page int")
    anchors = "array<struct<ref:string,char_offset:int>>"
    blocks = spark.createDataFrame([(1, 0, "heading", "Kopf", 7, []), (1, 1, "paragraph", "eins zwei", 7, [("X", 5), ("IX", 0), ("Y", 99)]), (1, 2, "paragraph", "drei", 8, None)], f"node int, block int, kind string, text string, page int, anchors {anchors}")
    notes = spark.createDataFrame([(1, 0, "*", "Note"), (1, 1, "1", "Mehr")], "node int, note int, marker string, text string")
    lines = sinks.markdown_lines(nodes, blocks.withColumn("anchors", F.coalesce("anchors", F.array().cast(anchors))), notes)
    got = {}
    for r in lines.orderBy("file", "n").collect():
        got.setdefault(r["file"], []).append(r["value"])
    assert got["004_ein-a.md"] == ["---", "position: 4", 'label: "Ein \\"A\\""', "depth: 2", "page: 7", "---", "", '# Ein "A"', "", "## {{{ 7 }}} Kopf", "", "{{ IX }} eins {{ X }} zwei{{ Y }} ", "", "{{{ 8 }}} drei", "", "[^*]: Note", "[^1]: Mehr"]
    assert got["005_leer.md"][-1] == "# Leer"
    sinks.write_files(lines, str(tmp_path / "out"))
    part = next((tmp_path / "out" / "file=004_ein-a.md").glob("*.txt"))
    assert part.read_text().split("\n")[:-1] == got["004_ein-a.md"]
    toc = sinks.toc_lines(nodes.withColumn("book", F.lit("k")).withColumn("has_file", F.col("node") == 1)).orderBy("n").collect()
    assert [r["value"] for r in toc] == ['  - [Ein "A"](004_ein-a.md) — p. 7', "- Leer — p. 9"]


def test_sitemaps(spark):
    day = datetime.datetime(2024, 5, 1)
    books = spark.createDataFrame([("a&b", day), ("c", None)], "book string, changed timestamp")
    nodes = spark.createDataFrame([("a&b", "n2", 2, day), ("a&b", "n<1", 1, day), ("gone", "x", 1, day)], "book string, node string, sort_order int, changed timestamp")
    got = {}
    for r in sinks.book_sitemaps(books, nodes, "https://h").orderBy("file", "n").collect():
        got.setdefault(r["file"], []).append(r["value"].strip())
    at = "<url><loc>https://h/books/a&amp;b"
    assert got["books/a&b.xml"] == [sinks.XML_HEAD, sinks.URLSET, f"{at}</loc><lastmod>2024-05-01</lastmod></url>", f"{at}/n&lt;1</loc><lastmod>2024-05-01</lastmod></url>", f"{at}/n2</loc><lastmod>2024-05-01</lastmod></url>", "</urlset>"]
    assert got["books/c.xml"][2] == "<url><loc>https://h/books/c</loc></url>"
    index = [r["value"].strip() for r in sinks.sitemap_index(books, "https://h").orderBy("n").collect()]
    assert index[1:4] == [sinks.INDEX, "<sitemap><loc>https://h/sitemaps/site.xml</loc></sitemap>", "<sitemap><loc>https://h/sitemaps/books/a&amp;b.xml</loc><lastmod>2024-05-01</lastmod></sitemap>"] and index[-1] == "</sitemapindex>"
