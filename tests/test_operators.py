import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codexweave.operators import hierarchy as T
from codexweave.operators import mutations as M
from codexweave.operators import ranges as A
from codexweave.operators import reconcile as C
from codexweave.sources import formats, markdown


@pytest.mark.parametrize("old, new, actions", [
    (["a b", "c d"], ["a b", "c d"], []),
    (["a b", "c d"], ["a  b", "C d"], ["keep", "keep"]),
    (["one two three"], ["one two tree"], ["keep"]),
    (["start", "one two three four"], ["start", "one two", "three four"], ["keep", "keep", "split"]),
    (["one two", "three four", "end"], ["one two three four", "end"], ["keep", "merge", "keep"]),
    (["a"], ["a", "b"], ["keep", "insert"]),
    (["a", "b"], ["b"], ["delete", "keep"]),
    (["abcdefgh"], ["zyxwvuts"], ["conflict"]),
    (["a", "b", "c"], ["x"], ["conflict"]),
])
def test_align(spark, old, new, actions):
    left = spark.createDataFrame([("u", str(i), i, t) for i, t in enumerate(old)], "unit string, id string, place int, text string")
    right = spark.createDataFrame([("u", i, t) for i, t in enumerate(new)], "unit string, place int, text string")
    assert sorted(r["action"] for r in C.align(left, right).collect()) == sorted(actions)


def test_anchors_follow(spark):
    plan = spark.createDataFrame([("u", "merge", "s2", "s1", 0), ("u", "delete", "s9", None, None)], "unit string, action string, old_id string, survivor string, place int")
    anchors = spark.createDataFrame([("q", "s2", None), ("r", "s3", "s4")], "name string, start string, end string")
    assert [tuple(r) for r in C.repoint(anchors, plan, ["start"]).orderBy("name").collect()] == [("q", "s1", None), ("r", "s3", "s4")]
    halves = spark.createDataFrame([("s2", "s2b"), ("s3", "s3b")], "old_id string, second string")
    assert [r["end"] for r in C.extend(anchors, halves, "start", "end").orderBy("name").collect()] == ["s2b", "s4"]
    assert C.refused(plan, spark.createDataFrame([("s9",)], "start string"), "start").first()["anchors"] == 1


def test_overlap_join(spark):
    rng = random.Random(1)
    spans = lambda n: [(rng.randrange(3), i, (a := rng.randrange(100)), a + rng.randrange(30)) for i in range(n)]
    left, right = spans(60), spans(60)
    got = A.overlap_join(spark.createDataFrame(left, "k int, i int, a int, b int"), spark.createDataFrame(right, "k int, j int, c int, d int"), ["k"], ("a", "b"), ("c", "d"), 10)
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= y[3] and x[3] >= y[2])
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_trees(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5)], "n int, p int")
    assert sorted(tuple(r) for r in T.roots(edges, "n", "p").collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)]
    assert sorted(r["n"] for r in T.cyclic(edges, "n", "p").collect()) == [5, 6]
    deep = spark.createDataFrame([(0, None), *[(i, i - 1) for i in range(1, 90)], (100, 101), (101, 102), (102, 100), (103, 101), (104, 103)], "n int, p int")
    assert {tuple(r) for r in T.roots(deep, "n", "p").collect()} == {(i, 0) for i in range(90)} | {(100, 100), (101, 101), (102, 102), (103, 101), (104, 101)}
    assert sorted(r["n"] for r in T.cyclic(deep, "n", "p").collect()) == [100, 101, 102, 103, 104]
    with pytest.raises(ValueError):
        T.forest(spark.createDataFrame([(1, None, 0), (2, 3, 0), (3, 2, 0)], "n int, p int, o int"), "n", "p", "o")
    coded = spark.createDataFrame([(i, i, f"l{i}") for i in range(5)], "i int, d int, l string").withColumn("b", F.lit(1))
    assert T.paths(coded, ["b"], ["i"], "d", "l").filter("i = 4").first()["path"] == ["l0", "l1", "l2", "l3", "l4"]
    trees = T.forest(spark.createDataFrame([(1, None, 0), (2, 1, 1), (3, 1, 0), (4, 3, 0)], "n int, p int, o int"), "n", "p", "o").first()
    assert [json.loads(x)["n"] for x in trees["children"]] == [3, 2]


def test_mutations(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    log = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, t int")
    once = M.upsert(table, log, ["k"], [F.desc("t")])
    twice = M.upsert(once, log, ["k"], [F.desc("t")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, M.insert_missing(table, log.select("k", "v"), ["k"]).collect()))[:2] == [(1, "a"), (2, "b")]
    owned = M.replace_set(table, spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "p"), (1, "p"), (2, "q")], "k int, v string"), ["k"])
    assert sorted(map(tuple, owned.collect())) == [(1, "p"), (2, "b")]


FILES = {
    "001.md": '---\nposition: 1\nlabel: "A \\"quoted\\" head"\ndepth: 2\n---\n## Title\n\nFirst line\nsecond line\n\n---\n\n[^a]: a note\n',
    "000_toc.md": "ignored",
}


def test_markdown(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    found = markdown.front_matter(markdown.files(spark, str(tmp_path)))
    row = found.first()
    assert (found.count(), row["position"], row["label"], row["depth"]) == (1, 1, 'A "quoted" head', 2)
    blocks = [(r["kind"], r["text"]) for r in markdown.prose(found).orderBy("position").collect()]
    assert blocks == [("heading", "Title"), ("paragraph", "First line second line"), ("separator", "---"), ("footnote", "[^a]: a note")]
    play = spark.createDataFrame([("p", "@ ANN\n| One\n| two\n@stage exits\nprose here")], "name string, body string")
    assert [r["kind"] for r in markdown.drama(play).orderBy("position").collect()] == ["speaker", "verse", "stage", "prose"]
    lifted = spark.range(1).select(markdown.markers(F.lit("{{{12}}} One {{b3}} two")).alias("m")).first()["m"]
    assert lifted["text"] == "One two" and [tuple(m) for m in lifted["markers"]] == [("block", "12", 0), ("inline", "b3", 4)]
    assert spark.range(1).select(markdown.owner(F.array(F.lit(0), F.lit(10)), F.lit(9))).first()[0] == 0


def test_formats(spark, tmp_path):
    folder = tmp_path / "kjv" / "gen"
    folder.mkdir(parents=True)
    (folder / "1.json").write_text(json.dumps({"verses": [{"chapter": 1, "verse": 1, "text": " In the beginning. "}]}))
    assert tuple(formats.verse_json(spark, str(tmp_path)).first()) == ("kjv", "gen", 1, 1, "In the beginning.")
    page = "<html><body><h2>Head</h2><p>One <i>two</i><a class='page'>[7]</a></p><div class='emptyLine'/><p>&nbsp;</p></body></html>"
    blocks = spark.createDataFrame([(page,)], "h string").select(formats.html_blocks(F.col("h")).alias("b")).first()["b"]
    assert [tuple(b) for b in blocks] == [("heading", "Head", "Head", None), ("paragraph", "One two", "One <i>two</i>", "7"), ("separator", "", "", None)]
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\nbad\ty\n")
    with pytest.raises(Exception):
        formats.checked_tsv(spark, str(tmp_path / "t.tsv"), "a int, b string").collect()


def run(writer):
    query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_streams(spark, tmp_path):
    from codexweave.operators.versions import Versions
    from codexweave.streaming import events as E

    rows = pd.DataFrame({"event_id": [1, 1, 2, 3], "ts": pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:00:01"]), "user_id": [7, 7, 7, 7], "value": [1.0, 1.0, 2.0, 3.0]})
    source = str(tmp_path / "in")
    spark.createDataFrame(rows).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = E.once(E.source(spark, source, schema))
    table = str(tmp_path / "table")
    kept = spark.createDataFrame([], "user_id long, event_id long, value double").schema
    run(stream.writeStream.option("checkpointLocation", str(tmp_path / "c1")).foreachBatch(E.upserting(table, ["user_id"], [F.desc("event_id")], kept)))
    assert [tuple(r) for r in Versions(spark, table).read().collect()] == [(7, 3, 3.0)]
    limited = E.rate_limited(E.source(spark, source, schema), "user_id", 2, 0.001)
    run(limited.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")))
    assert sorted(r["allowed"] for r in spark.table("limited").collect()) == [False, False, True, True]


def test_not_additive_across_ranges(spark):
    from codexweave.operators import reconcile as C

    old = spark.createDataFrame([(i, i) for i in range(200)], "k int, n int").repartition(4)
    new = spark.createDataFrame([(i, i if i != 100 else 0) for i in range(200) if i % 7], "k int, n int")
    assert sorted(tuple(r) for r in C.not_additive(old, new, "k", "n").collect()) == sorted([(i, "removed") for i in range(0, 200, 7)] + [(100, "moved")])


def test_predicates(spark):
    from codexweave.operators import predicates as P

    df = spark.createDataFrame([(1, "50%_a"), (2, "50 xa"), (3, None)], "k int, v string")
    found = lambda d: sorted(r["k"] for r in d.collect())
    assert found(df.filter(P.contains(F.col("v"), "%_A"))) == [1] and found(df.filter(P.contains(F.col("v"), "0_X", False))) == [2]
    assert found(P.among(df, "k", [])) == [] and found(P.optional(df, {"k": None, "v": None})) == [1, 2, 3] and found(P.optional(df, {"k": 2})) == [2]
    texts = ["", "abc", "aé", "日本語", "a\U0001f600b"]
    for n in range(1, 9):
        got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", P.snippet(F.col("x"), n).alias("s")).collect()
        assert {r["x"]: r["s"] for r in got} == {x: x.encode()[:n].decode(errors="ignore") for x in texts}
    page = P.anchored_page(spark.range(10).toDF("n"), "n", 0, 0, 99).collect()
    assert len(page) == 10 and not page[0]["has_more"] and not page[0]["has_previous"]


def test_walks_to_roots_send_no_table_through_the_driver(spark, monkeypatch):
    """Keys in order compress well, so tables of them look small enough to be broadcast when they are not."""
    plans, write = [], T.staged
    monkeypatch.setattr(T, "staged", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    edges = spark.range(3000).select("id", (F.when(F.col("id") % 5 != 0, F.floor(F.col("id") / 3))).alias("up"))
    found = T.roots(edges, "id", "up")
    plans.append(found._jdf.queryExecution().executedPlan().toString())

    def top(k):
        while k % 5:
            k //= 3
        return k

    assert {r.id: r.root for r in found.collect()} == {k: top(k) for k in range(3000)}
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_html_blocks_send_pages_to_python_in_small_batches(spark):
    from codexweave.operators.lineage import BATCH
    from codexweave.plans import registry
    from oracle import FOLDER

    set_ = spark.conf.get(BATCH, None)
    spark.conf.unset(BATCH)
    registry.queries()["html_blocks"](spark, FOLDER)
    assert spark.conf.get(BATCH) == "4m"
    spark.conf.set(BATCH, set_ or "4m")


def test_align_writes_each_text_once_and_joins_by_hashes(spark, monkeypatch):
    plans, write = [], C.staged
    monkeypatch.setattr(C, "staged", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or write(df))
    old = spark.createDataFrame([("u", f"s{i}", i, f"sentence {i}") for i in range(5)], "unit string, id string, place int, text string")
    new = spark.createDataFrame([("u", 0, "sentence 0 sentence 1"), *[("u", i, f"sentence {i}") for i in range(2, 5)]], "unit string, place int, text string")
    rows = {(r.action, r.old_id, r.survivor, r.place) for r in C.align(old, new).collect()}
    assert rows == {("keep", "s0", "s0", 0), ("merge", "s1", "s0", 0), ("keep", "s2", "s2", 1), ("keep", "s3", "s3", 2), ("keep", "s4", "s4", 3)}
    assert not any("text" in columns for columns, _ in plans)
