"""The revision queries over whole documents, against plain Python."""

import random
import re

from codexweave.functions import text as X
from codexweave.operators import reconcile
from codexweave.plans import registry
from pyspark.sql import functions as F

rng = random.Random(8)
LONG = "\n".join(" ".join("word%d" % rng.randrange(90) + ("." if rng.random() < 0.1 else "") for _ in range(60)) for _ in range(20))
DOCS = [
    (0, "One here. Two there! Three?\n\nA line. And more.", 44), (1, "Alone\nFirst. Second.", 20), (2, LONG, len(LONG)), (3, "No length. Known.", None), (4, LONG, len(LONG)),
    (5, LONG + "\n", len(LONG) + 1), (6, None, None), (7, "", 0), (8, "x" * 30_000, 30_000), (9, "a. b.\n  ", 8),
]


def normal(text: str) -> str:
    return " ".join(text.split()).lower()


def similarity(x: str, y: str) -> float:
    x, y = normal(x), normal(y)
    longest = max(len(x), len(y))
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    x, y = x[head:], y[head:]
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return 1 - row[-1] / longest if longest else 1.0


def plan_unit(old: list[tuple[str, str]], new: list[str]) -> list[tuple]:
    """Steps (action, old id, survivor, new place), by the rules in order."""
    conflict, m, n = [("conflict", None, None, None)], len(old), len(new)
    if m == n:
        if any(normal(a) != normal(b) and similarity(a, b) < 0.25 for (_, a), b in zip(old, new)):
            return conflict
        return [("keep", i, i, k) for k, (i, _) in enumerate(old)]
    head = next((k for k in range(min(m, n)) if normal(old[k][1]) != normal(new[k])), min(m, n))
    tail = next((k for k in range(min(m, n) - head) if normal(old[-1 - k][1]) != normal(new[-1 - k])), min(m, n) - head)
    a, b = old[head : m - tail], new[head : n - tail]
    steps = [("keep", i, i, k) for k, (i, _) in enumerate(old[:head])] + [("keep", i, i, n - tail + k) for k, (i, _) in enumerate(old[m - tail :])]
    if (len(a), len(b)) == (1, 2) and similarity(a[0][1], " ".join(b)) >= 0.9:
        return [*steps, ("keep", a[0][0], a[0][0], head), ("split", a[0][0], a[0][0], head + 1)]
    if (len(a), len(b)) == (2, 1) and similarity(f"{a[0][1]} {a[1][1]}", b[0]) >= 0.9:
        return [*steps, ("keep", a[0][0], a[0][0], head), ("merge", a[1][0], a[0][0], head)]
    if (len(a), len(b)) == (0, 1):
        return [*steps, ("insert", None, None, head)]
    return [*steps, ("delete", a[0][0], None, None)] if (len(a), len(b)) == (1, 0) else conflict


def units() -> dict:
    out = {}
    for d, text, _ in DOCS:
        for k, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                out[d, k] = [s.strip() for s in re.sub(r"([.!?…]+)\s+(?=\S)", "\\1\x01", line).split("\x01") if s.strip()]
    return out


def plans(new: dict) -> list[tuple]:
    out = []
    for (d, k), sentences in units().items():
        if new[d, k] != sentences:
            old = [(f"d{d}.b{k}.s{n}", s) for n, s in enumerate(sentences)]
            out += [(f"d{d}.b{k}", *step) for step in plan_unit(old, new[d, k])]
    return out


def tables(spark, tmp_path) -> str:
    spark.createDataFrame(DOCS, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_align_plan_of_whole_documents(spark, tmp_path):
    new = units()
    for d, k in new:
        if d % 4 == 0 and k == 0:
            new[d, k] = [new[d, k][0] + " indeed", *new[d, k][1:]]
        if d % 4 == 1 and k == max(y for x, y in new if x == d):
            new[d, k] = [*new[d, k], "An added sentence."]
    got = [tuple(r[c] for c in ("unit", "action", "old_id", "survivor", "place")) for r in registry.queries()["align_plan"](spark, tables(spark, tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(plans(new), key=str) and {"d4.b0", "d8.b0", "d9.b0"} <= {x[0] for x in got}


def test_anchors_after_merge_of_whole_documents(spark, tmp_path):
    merged = {u: [" ".join(s[:2]), *s[2:]] for u, s in units().items()}
    to = {old: survivor for _, action, old, survivor, _ in plans(merged) if action == "merge"}
    expected = [to.get(i, i) for (d, k), s in units().items() for i in (f"d{d}.b{k}.s{n}" for n in range(len(s)))]
    got = [r["anchor"] for r in registry.queries()["anchors_after_merge"](spark, tables(spark, tmp_path)).collect()]
    assert sorted(got) == sorted(expected) and any(i.startswith("d2.") for i in got)


def test_distance_of_common_ends(spark):
    pairs = [tuple("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(2)) for _ in range(300)] + [("x" * 20_000 + "a" + "y" * 20_000, "x" * 20_000 + "bc" + "y" * 20_000)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string")
    got = {r["i"]: r["s"] for r in rows.select("i", X.similar(F.col("x"), F.col("y")).alias("s")).collect()}
    for i, (x, y) in enumerate(pairs[:-1]):
        assert abs(got[i] - similarity(x, y)) < 1e-9
    assert abs(got[300] - (1 - 2 / 40_002)) < 1e-12


def test_plans_of_random_units(spark):
    """Splits, merges, inserts, deletions, edits and scrambles of small units, as by the rules one after the other."""
    words = ["alpha", "beta", "gamma", "delta"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) + "."
    old, new = {}, {}
    for u in range(400):
        a = [sentence() for _ in range(rng.randint(0, 5))]
        b = list(a)
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            kind, k = rng.randrange(6), rng.randrange(len(b) + 1)
            if kind == 0 or not b:
                b.insert(k, sentence())
            elif kind == 1:
                b.pop(min(k, len(b) - 1))
            elif kind == 2 and len(b) > 1:
                k = min(k, len(b) - 2)
                b[k : k + 2] = [b[k] + "  " + b[k + 1].upper()]
            elif kind == 3:
                k = min(k, len(b) - 1)
                half = len(b[k]) // 2
                b[k : k + 1] = [b[k][:half], b[k][half:]]
            elif kind == 4:
                b[min(k, len(b) - 1)] = "zzzz qqq www vvv kkk"
            else:
                b[min(k, len(b) - 1)] += " tail"
        if a or b:
            old[f"u{u}"], new[f"u{u}"] = a, b
    left = [(u, f"{u}.{k}", k * 2, s) for u, x in old.items() for k, s in enumerate(x)]
    right = [(u, k + 5, s) for u, x in new.items() for k, s in enumerate(x)]
    plan = reconcile.align(spark.createDataFrame(left, "unit string, id string, place int, text string"), spark.createDataFrame(right, "unit string, place int, text string"))
    expected = [(u, *step) for u in old if old[u] != new[u] for step in plan_unit([(f"{u}.{k}", s) for k, s in enumerate(old[u])], new[u])]
    got = [tuple(r[c] for c in ("unit", "action", "old_id", "survivor", "place")) for r in plan.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and {x[1] for x in got} == {"keep", "split", "merge", "insert", "delete", "conflict"}


def test_numbers_of_a_book_larger_than_a_task(spark):
    """A book of many rows is dealt over several ranges, null keys are a book, and no range is numbered for itself."""
    from codexweave.operators import numbering as N

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(4000).select(F.when(F.col("id") % 4 > 0, "a").when(F.col("id") % 8 == 0, "b").alias("book"), F.pmod(F.col("id") * 7919, F.lit(4001)).alias("place"))
        found = N.renumber(rows, ["book"], ["place"], "number", 5)
        assert found.columns == ["book", "place", "number"] and found.schema["number"].dataType.simpleString() == "bigint"
        got = found.collect()
        for book in ("a", "b", None):
            assert [r["number"] for r in sorted((r for r in got if r["book"] == book), key=lambda r: r["place"])] == list(range(5, 5 + sum(r["book"] == book for r in got)))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number() windowspecdefinition(book" in plan and "_r#" in plan.split("row_number() windowspecdefinition(", 1)[1].split(" ASC", 1)[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
