"""Licenses, benchmark leaks, lines and the pipeline, against brute force and planted cases."""

import random
import re

import brute
import corpus_pipeline
import pyarrow as pa
import pytest
from codexweave.llm import entries, leaks, licenses, lines
from codexweave.llm.words import bare
from oracle import FOLDER
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, id long, row int"
rng = random.Random(12)
WORDS = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(800)]


def prose(n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 8) for i, t in rows], SCHEMA)


def test_licenses(spark):
    mit, apache = licenses.TEMPLATES["MIT permission"], licenses.TEMPLATES["Apache-2.0"]
    rows = [
        (1, None), (2, ""), (3, prose(400)), (4, f"{prose(30)} {mit.upper()}, {prose(20)}"), (5, prose(5) + "\n" + mit.replace("charge", "any charge at all").replace("software", "program", 1)),
        (6, f"{apache} {prose(10)} {apache}"), (7, " ".join(mit.split()[: len(mit.split()) // 2])), (None, mit), (8, " ".join(reversed(mit.split()))), (9, prose(20_000) + " " + mit),
    ]
    found = {}
    for r in licenses.scan(frame(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append((r["first_word"], r["end_word"], r["license"], r["coverage"]))
    n = len(re.findall(r"[a-z]+", mit.lower()))
    assert found[4] == [(30, 30 + n, "MIT permission", 1.0)]
    assert [x[2] for x in found[5]] == ["MIT permission"] and found[5][0][3] < 1
    assert [x[2] for x in found[6]] == ["Apache-2.0"] * 2
    assert found[9] == [(20_000, 20_000 + n, "MIT permission", 1.0)]
    assert set(found) == {4, 5, 6, 9, None}
    assert licenses.scan(frame(spark, [])).count() == 0
    assert licenses.op5_patience_licenses(spark, FOLDER).count() > 0


def test_notices_are_not_misnamed():
    """Notices of one form differ by their telling words, and a near notice is not named by another."""
    cases = {
        "Released under the Apache License": ["Apache short"], "Released under the MIT License": ["MIT"], "Released under the Foo License": [],
        "Licensed under CC BY-ND 4.0": ["CC-BY-ND-4.0"], "Licensed under CC BY 4.0": ["CC-BY-4.0"], "Licensed under CC BY-NC-SA 4.0": ["CC-BY-NC-SA-4.0"],
        "This work is licensed under the GNU General Public License, version 2": ["GPL-2.0"],
        "This work is licensed under the GNU General Public License, version 3": ["GPL-3.0"],
        "This work is licensed under the GNU General Public License, version 9": [],
    }
    hashed = {name: bare(pa.array([t]))[1] for name, t in licenses.TEMPLATES.items()}
    telling = {name: bare(pa.array([t]))[1].tolist() for name, t in licenses.TELLING.items()}
    assert set(telling) <= set(hashed) and all(set(x) <= set(hashed[name].tolist()) for name, x in telling.items())
    for text, names in cases.items():
        for words in (text, f"{prose(40)} {text.upper()} {prose(40)}"):
            assert [x[0] for x in licenses.notices(bare(pa.array([words]))[1], hashed, telling)] == names, words


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        x, y = ([rng.randint(0, 6) for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = licenses.align(x, y)
        assert all(x[a] == y[b] for a, b in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        if x == y:
            assert len(pairs) == len(x)


def test_leaks(spark):
    items = [(i, f"{prose(20)}? {prose(8)}.") for i in range(12)] + [(50, None), (51, ""), (52, "two words")]
    quoted = [(100 + i, f"{prose(80)} {t} {prose(50)}") for i, t in items[:6]]
    spelled = [(200 + i, f"{prose(30)}\n{t.upper().replace(' ', '   ')}, {prose(5)}") for i, t in items[:6]]
    words = [t.split() for _, t in items[:6]]
    altered = [(300 + i, f"{prose(90)} {' '.join('other' if k % 8 == 3 else x for k, x in enumerate(w))} {prose(70)}") for i, w in enumerate(words)]
    clean = [(400 + i, prose(200)) for i in range(40)] + [(450, None), (451, ""), (452, "one"), (453, prose(30_000))]
    half = [(500 + i, f"{prose(40)} {' '.join(w[: len(w) // 3])} {prose(40)}") for i, w in enumerate(words)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.search(frame(spark, quoted + spelled + altered + clean + half), bench).collect()}
    assert got == {(base + i, i) for base in (100, 200, 300) for i in range(6)}
    assert leaks.search(frame(spark, []), bench).count() == 0
    assert leaks.search(frame(spark, quoted), bench.limit(0)).count() == 0


def test_leaks_of_exact_passages(spark):
    """Every document of the table that holds a whole item, by its words, is found."""
    form = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    docs = [(r["doc_id"], form(r["text"])) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [form(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    whole = {i for i, t in docs if any(x in t for x in items)}
    got = {r["doc_id"] for r in leaks.op7_latent_decontamination(spark, FOLDER).collect()}
    assert whole and whole <= got


def _normal(line: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", line.lower()))


def brute_lines(docs):
    """All pairs of lines: the expected result if every pair that is similar enough is also near in its SimHash."""
    seen = [((i, n), _normal(x)) for i, t in docs if t is not None for n, x in enumerate(t.split("\n"))]
    seen = sorted((k, x) for k, x in seen if len(x.split()) >= lines.MIN_WORDS)
    parent = {k: k for k, _ in seen}
    for a, (k, x) in enumerate(seen):
        for m, y in seen[a + 1 :]:
            allowed = int(max(len(x), len(y)) * (1 - lines.SIMILARITY) + 1e-9)
            if abs(len(x) - len(y)) <= allowed and brute.distance(x, y) <= allowed:
                brute.join(parent, k, m)
    gone = {k for k, _ in seen if brute.find(parent, k) != k}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in docs if t is not None}


LINES = [prose(12) for _ in range(6)]


def test_lines(spark):
    docs = [
        (1, None), (2, ""), (3, "\n\n"), (4, "\n".join(LINES[:3])), (5, f"{LINES[0]}\nshort line\nshort line\n{LINES[3]}\n"), (6, f"  {LINES[1].upper()}!  \n{LINES[4]}"), (7, "\n".join([LINES[5]] * 40)),
        (8, LINES[2].replace(" ", ", ")), (9, f"{prose(5000)}\n{LINES[5]}"), (10, "Straße über Brücke nach Köln\nSTRASSE und mehr hier noch\nstraße ÜBER brücke nach köln"),
    ]
    got = {r["doc_id"]: r for r in lines.dedup(frame(spark, docs)).collect()}
    assert {i: r["text"] for i, r in got.items() if r["text"] is not None} == brute_lines(docs)
    assert got[1]["text"] is None and got[1]["n_lines"] == 0 and got[7]["n_removed"] == 39
    assert {r["lang"] for r in got.values()} == {"x"} and {r["row"] for r in got.values()} == {8}
    assert lines.dedup(frame(spark, [])).count() == 0


def direct_links(df) -> set:
    pairs = lines.candidates(lines.blocks(lines.distinct_lines(lines.occurrences(df))))
    found = lines.fetched(df, pairs.select(F.explode(F.array("u", "v")).alias("id")))
    return {tuple(sorted((r["u"]["doc_id"], r["v"]["doc_id"]))) for r in lines.links(pairs, found).collect()}


def test_edits_scattered_through_lines(spark):
    """A line and its copy with one letter, 5 % or 9 % of letters changed anywhere: nine pairs in ten at least are linked in each cell; nothing else is."""
    rng, docs, cells = random.Random(21), [], {}
    for words in (5, 8, 10, 12, 20, 24, 30, 40, 60, 80, 150):
        for share in (0, 0.05, 0.09):
            for _ in range(40):
                base = prose(words)
                letters = [i for i, c in enumerate(base) if c != " "]
                new = list(base)
                for i in rng.sample(letters, max(1, int(share * len(letters)))):
                    new[i] = rng.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c != base[i]])
                cells.setdefault((words, share), []).append((len(docs), len(docs) + 1))
                docs += [(len(docs), base), (len(docs) + 1, "".join(new))]
    linked = direct_links(frame(spark, docs).coalesce(1))
    assert linked <= {p for c in cells.values() for p in c}
    found = {c: sum(p in linked for p in ps) for c, ps in cells.items()}
    assert all(n >= 36 for n in found.values()), found


def test_lines_that_meet_in_large_blocks_only(spark):
    """Two similar lines whose common pairs of words stand in many earlier lines too, while their other pairs are rare."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") for _ in range(6))
    docs, twins = [], []
    for _ in range(4):
        a = [word() for _ in range(20)]
        b = [w[:2] + "x" + w[3:] if i % 3 == 2 else w for i, w in enumerate(a)]
        for i in range(0, 20, 3):
            for _ in range(18):
                docs.append(" ".join([word(), word(), *a[i : i + 2], word()]))
        for i in range(1, 18, 3):
            for _ in range(18):
                docs.append(" ".join([word(), a[i], word(), a[i + 2], word()]))
        twins += [" ".join(a), " ".join(b)]
    n = len(docs)
    linked = removals(spark, list(enumerate(docs + twins)))
    assert linked == {n + 1, n + 3, n + 5, n + 7}


def removals(spark, docs):
    """doc_ids of one-line documents whose line goes."""
    return {r.doc_id for r in lines.dedup(frame(spark, docs)).filter("n_removed > 0").collect()}


def test_fuzzy_lines(spark):
    """Of all pairs within the edit similarity, nine in ten are linked at each length; nothing else is. No SimHash or segment is used here."""
    rng = random.Random(8)

    def edited(line: str, how: int) -> str:
        w = line.split()
        i = rng.randrange(len(w))
        if how == 0:
            w[i] = ("q" + w[i][1:]) if len(w[i]) > 1 else "q"
        elif how == 1:
            w[i] = "".join(rng.choice("qxz") for _ in w[i])
        elif how == 2:
            w.insert(i, "qq")
        else:
            del w[i]
        return " ".join(w)

    docs, family = {}, {}
    for words in (8, 12, 15, 20, 40, 47, 80):
        for _ in range(8):
            base = prose(words)
            for x in [base, *[edited(base, k % 4) for k in range(7)]]:
                docs.setdefault(x, len(docs))
                family.setdefault((words, base), []).append(docs[x])
    docs = {i: x for x, i in docs.items()}
    parent, pairs = {i: i for i in docs}, {}
    for (words, _), members in family.items():
        for n, i in enumerate(sorted(set(members))):
            for k in sorted(set(members))[n + 1 :]:
                allowed = int(max(len(docs[i]), len(docs[k])) * (1 - lines.SIMILARITY) + 1e-9)
                if brute.distance(docs[i], docs[k]) <= allowed:
                    pairs[i, k] = words
                    brute.join(parent, i, k)
    df = frame(spark, list(docs.items())).coalesce(1)
    linked = direct_links(df)
    assert linked <= set(pairs)
    share = {n: (sum(p in linked for p, m in pairs.items() if m == n), sum(m == n for m in pairs.values())) for n in set(pairs.values())}
    assert all(a >= 0.9 * b and b > 20 for a, b in share.values()), share
    got = {r["doc_id"]: r["text"] for r in lines.dedup(df).collect()}
    gone, expected = {i for i, t in got.items() if t == ""}, {i for i in parent if parent[i] != i}
    assert gone <= expected and len(gone) >= 0.95 * len(expected)
    assert all(t in ("", docs[i]) for i, t in got.items())


def test_lines_of_a_large_block(spark):
    """Lines that share their beginning but little else stay; those that are similar to another one than the block's first go."""
    start = prose(10)
    some = [f"{start} {prose(14)}" for _ in range(60)]
    docs = [(i, x) for i, x in enumerate(some)] + [(1000 + i, x + "q") for i, x in enumerate(some) if i % 3 == 1]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(frame(spark, docs)).collect()}
    assert {i for i, t in got.items() if t == ""} == {i for i, _ in docs if i >= 1000}


def test_unlike_lines_of_a_block_are_no_candidates(spark):
    """Lines that share two words and their length but nothing else leave their block by SimHash, before any text is read again."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") for _ in range(7))
    docs = []
    for _ in range(40):
        both = [word(), word()]
        docs += [" ".join([*[word() for _ in range(5)], *both, *[word() for _ in range(5)]]) for _ in range(2)]
    df = frame(spark, list(enumerate(docs)))
    assert lines.candidates(lines.blocks(lines.distinct_lines(lines.occurrences(df)))).count() < 20


def test_lines_with_a_frequent_pair_are_told_apart(spark):
    """Lines that share two words and nothing else don't make one large block; the two that are similar still meet."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") for _ in range(7))
    docs = [" ".join([*[word() for _ in range(5)], "frequent", "neighbours", *[word() for _ in range(5)]]) for _ in range(1500)]
    docs.append(docs[700][:-1] + "q")
    placed = lines.blocks(lines.distinct_lines(lines.occurrences(frame(spark, list(enumerate(docs))))))
    assert placed.filter(F.col("n") > lines.MANY).count() == 0
    assert (700, 1500) in {(r["u"]["doc_id"], r["v"]["doc_id"]) for r in lines.candidates(placed).collect()}


def test_lines_and_clashing_columns(spark):
    names = ["n_removed", "n_lines", "_id", "_places", "_row", "_lines", "row", "pos", "places", "d", "left", "lines", "segments"]
    df = spark.createDataFrame([(i, f"{LINES[0]}\n{LINES[i]}", *range(len(names))) for i in range(1, 4)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = sorted(lines.dedup(df).collect())
    assert [r["n_removed"] for r in got] == [0, 1, 1] and [r["text"] for r in got] == [f"{LINES[0]}\n{LINES[1]}", LINES[2], LINES[3]]
    assert all(r[n] == k for r in got for k, n in enumerate(names) if k > 1)


def test_repeated_rows_of_lines(spark):
    docs = [(1, LINES[0]), (1, LINES[0]), (2, LINES[0]), (None, LINES[0])]
    got = sorted((str(r["doc_id"]), r["text"]) for r in lines.dedup(frame(spark, docs)).collect())
    assert got == [("1", ""), ("1", ""), ("2", ""), ("None", LINES[0])]


def test_lines_of_the_table(spark):
    src = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in lines.op10_line_dedup(spark, FOLDER).collect()}
    assert set(got) == set(src)
    seen, total = set(), 0
    for i in sorted(src):
        exact = 0
        for x in src[i].split("\n"):
            n = _normal(x)
            if len(n.split()) >= lines.MIN_WORDS:
                exact += n in seen
                seen.add(n)
        assert got[i]["n_removed"] >= exact and got[i]["n_lines"] == len(src[i].split("\n"))
        total += exact
    assert total > 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("extra", F.lit(1))
    before, stages = docs, dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, before, FOLDER).write.parquet(path := f"{tmp_path}/{name}")
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        a, b = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (before, after))
        assert set(b) < set(a) or (name == "line dedup" and set(b) <= set(a) and b != a)
        if name == "MinHash near-dedup":
            assert set(b) == {i for i, _, _, kept in brute.near_dups(sorted(a.items())) if kept}
        if name != "line dedup":
            assert all(a[i] == t for i, t in b.items())
        before = after
    packed = stages["best-fit packing"](spark, before, FOLDER)
    assert packed.select("doc_id").distinct().count() == before.count()
    names = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(packed.select(names).collect()) == sorted(corpus_pipeline.run(spark, FOLDER).select(names).collect())


@pytest.mark.parametrize("stage", [x[0] for x in corpus_pipeline.STAGES])
def test_pipeline_odd_inputs(spark, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    like = "doc_id long, text string, lang string, source string, n_chars long, row int, id long"
    f(spark, spark.createDataFrame([], like), FOLDER).collect()
    f(spark, spark.createDataFrame([(1, None, None, None, None, 1, 2), (1, None, None, None, None, 1, 2), (2, "", "", "", 0, 1, 2), (3, prose(30), None, "s", 9, None, None)], like), FOLDER).collect()


def test_pipeline_rows_of_null_and_repeated_ids(spark):
    """One survivor of each text, whatever the ids; contaminated rows go, with or without an id; columns of any name stay."""
    stages = dict(corpus_pipeline.STAGES)
    a, b, c, d = (prose(60) for _ in range(4))
    like = "doc_id long, text string, n_chars long, row long, cluster long, kept int, _id int, x int, twin int"
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a), (None, c), (None, c), (4, d), (4, d), (5, None), (5, None), (6, "")]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, 7) for i, t in rows], like)
    left = stages["MinHash near-dedup"](spark, df, FOLDER)
    assert left.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(1, a), (2, b), (None, c), (4, d), (5, None), (5, None), (6, "")], key=str)
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first()["text"]
    dirty = f"{prose(50)} {item} {prose(50)}"
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, 7) for i, t in [(1, dirty), (None, dirty), (1, a), (None, b), (2, c)]], like)
    left = stages["benchmark decontamination"](spark, df, FOLDER)
    assert left.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(1, a), (None, b), (2, c)], key=str)
    clash = spark.createDataFrame([(1, f"{LINES[0]}\n{LINES[1]}", 1, 2, 3, 4, 5, 6, 7), (2, LINES[0], 1, 2, 3, 4, 5, 6, 7)], "doc_id long, text string, n_chars long, n_removed long, n_lines long, _row int, left int, d int, places int")
    left = stages["line dedup"](spark, clash, FOLDER).collect()
    assert [tuple(r) for r in left] == [(1, f"{LINES[0]}\n{LINES[1]}", 1, 2, 3, 4, 5, 6, 7)]


def test_every_operator_is_registered():
    names = list(entries.queries())
    assert [x.split("_")[0] for x in names] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
