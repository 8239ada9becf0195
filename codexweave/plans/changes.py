"""Writes, revisions and sources as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sentences as S
from ..functions import text as X
from ..operators import mutations as M
from ..operators import reconcile as C
from ..operators.lineage import lean, staged
from ..sources import formats, markdown
from .tables import query


@query("""
SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_nationkey)""")
def insert_missing_rows(t):
    return M.insert_missing(t.region, t.nation.select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name")), ["r_regionkey"])


@query("""
WITH n AS (SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1)
SELECT c_custkey, coalesce(n.value, c_acctbal) AS balance FROM customer LEFT JOIN n ON user_id = c_custkey""")
def upsert_balances(t):
    table = t.customer.select("c_custkey", F.col("c_acctbal").alias("balance"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    rows = t.events.filter("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"), F.col("value").alias("balance"), "ts", "event_id").join(t.customer, "c_custkey", "left_semi")
    return M.upsert(table, rows, ["c_custkey"], [F.desc("ts"), F.desc("event_id")]).select("c_custkey", "balance")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'renamed' ELSE p_name END AS p_name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS p_type FROM part""")
def tri_state_patch(t):
    changes = t.part.select("p_partkey", F.lit("renamed").alias("p_name"), F.lit(None).cast("string").alias("p_type"), (F.col("p_partkey") % 3 == 0).alias("set_p_name"), (F.col("p_partkey") % 4 == 0).alias("set_p_type"))
    return M.patch(t.part.select("p_partkey", "p_name", "p_type"), changes, ["p_partkey"], ["p_name", "p_type"])


@query("SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) OR n_nationkey % 2 = 1")
def guarded_delete(t):
    left, _ = M.delete_unreferenced(t.nation, t.nation.filter("n_nationkey % 2 = 0"), ["n_nationkey"], t.supplier.select(F.col("s_nationkey").alias("n_nationkey")))
    return left.select("n_nationkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def status_transition(t):
    return M.transition(t.orders.select("o_orderkey", "o_orderstatus"), t.orders.filter("o_orderkey % 2 = 0"), ["o_orderkey"], "o_orderstatus", "O", "P")


@query("""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY fresh, position) AS position FROM (SELECT conv_id, turn + 1000 AS turn, 0 AS fresh, turn AS position FROM conversations WHERE turn = 0
UNION ALL SELECT conv_id, turn, 1, turn FROM conversations)""")
def prepend_members(t):
    rows = t.conversations.select("conv_id", "turn", F.col("turn").alias("position"))
    return M.prepend(rows, rows.filter("turn = 0").withColumn("turn", F.col("turn") + 1000), "conv_id", "position")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations WHERE role <> 'system' AND turn % 2 = 0")
def remove_members(t):
    rows = t.conversations.filter("role <> 'system'").select("conv_id", "turn", F.col("turn").alias("position"))
    return M.remove_dense(rows, rows.filter("turn % 2 = 1"), "conv_id", "turn", "position")


@query("SELECT event_id FROM events WHERE epoch_us(ts) >= (SELECT max(epoch_us(ts)) FROM events) - 432000000000 AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def expire_sessions(t):
    newest = t.events.agg(F.max("ts")).first()[0]
    parents = t.customer.filter("c_nationkey < 10").select(F.col("c_custkey").alias("user_id"))
    return M.expire(t.events, "ts", F.lit(newest).cast("timestamp"), 5 * 86_400, parents, "user_id").select("event_id")


def _revisions(t):
    """Sentences of all documents' lines that aren't blank, a line being a unit, and a second revision: some edited, some appended."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block", "line")).filter("trim(line) <> ''")
    words = lines.select("doc_id", "block", F.posexplode(S.structural(F.col("line"))).alias("place", "text"))
    old = words.select(F.format_string("d%d.b%d", "doc_id", "block").alias("unit"), F.format_string("d%d.b%d.s%d", "doc_id", "block", "place").alias("id"), "place", "text", "doc_id", "block")
    old = staged(old)
    edited = F.when((F.col("doc_id") % 4 == 0) & (F.col("block") == 0) & (F.col("place") == 0), F.concat("text", F.lit(" indeed"))).otherwise(F.col("text"))
    new = old.select("unit", "place", edited.alias("text"), "doc_id", "block")
    ends = new.filter("doc_id % 4 = 1").groupBy("doc_id").agg(F.max(F.struct("block", "place", "unit")).alias("end"))
    tail = ends.select("end.unit", (F.col("end.place") + 1).alias("place"), F.lit("An added sentence.").alias("text"))
    return old.drop("doc_id", "block"), new.drop("doc_id", "block").unionByName(tail)



_UNITS = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block FROM documents),
p AS (SELECT doc_id, block, string_split(regexp_replace(line, '([.!?…]+\s+)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM l WHERE trim(line) <> ''),
q AS (SELECT doc_id, block, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM p),
u AS (SELECT 'd' || doc_id || '.b' || block AS unit, doc_id, block, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS k, len(parts) AS m FROM q)"""

@query(_UNITS + """,
n AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(CASE WHEN k = 0 AND block = 0 AND doc_id % 4 = 0 THEN text || ' indeed' ELSE text END, '\\s+', ' ', 'g'))) AS b FROM u),
e AS (SELECT unit, m, bool_or(a <> b AND 1 - levenshtein(a, b) / greatest(length(a), length(b)) < 0.25) AS bad FROM n WHERE doc_id % 4 = 0 AND block = 0 GROUP BY unit, m),
t AS (SELECT DISTINCT u.unit, u.m FROM u JOIN (SELECT doc_id, max(block) AS block FROM u GROUP BY doc_id) x ON u.doc_id = x.doc_id AND u.block = x.block WHERE u.doc_id % 4 = 1)
SELECT unit, 'keep' AS action, unit || '.s' || k AS old_id, unit || '.s' || k AS survivor, k::INT AS place FROM u WHERE unit IN (SELECT unit FROM t UNION ALL SELECT unit FROM e WHERE NOT bad)
UNION ALL SELECT unit, 'conflict', NULL, NULL, NULL FROM e WHERE bad UNION ALL SELECT unit, 'insert', NULL, NULL, m::INT FROM t""")
def align_plan(t):
    return C.align(*_revisions(t))


@query(_UNITS + " SELECT CASE WHEN k = 1 THEN unit || '.s0' ELSE unit || '.s' || k END AS anchor FROM u")
def anchors_after_merge(t):
    old, _ = _revisions(t)
    first = old.filter("place <= 1").groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ").alias("text"))
    plan = C.align(old, old.filter("place > 1").select("unit", "place", "text").unionByName(first.select("unit", F.lit(0).alias("place"), "text")))
    return C.repoint(old.select(F.col("id").alias("anchor")), plan, ["anchor"])


@query("""
WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 7 THEN o_orderkey - 1000 ELSE o_orderkey END AS b FROM orders WHERE o_orderkey % 100 <> 5)
SELECT o_orderkey, 'removed' AS reason FROM orders WHERE o_orderkey % 100 = 5
UNION ALL SELECT o_orderkey, 'moved' FROM (SELECT o_orderkey, b < lag(b) OVER (ORDER BY o_orderkey) AS m FROM k) WHERE m""")
def not_additive_nodes(t):
    """A second revision without some keys, and with others moved forward by 1000."""
    keys = t.orders.select("o_orderkey", F.col("o_orderkey").alias("n"))
    moved = F.when(F.col("o_orderkey") % 50 == 7, F.col("n") - 1000).otherwise(F.col("n"))
    return C.not_additive(keys, keys.filter("o_orderkey % 100 <> 5").withColumn("n", moved), "o_orderkey", "n")


@query()
def html_blocks(t):
    return lean(t.pages).select("page_id", F.posexplode(formats.html_blocks(F.col("html"))).alias("position", "b")).select("page_id", "position", "b.*")


@query()
def sentence_split_language(t):
    return t.documents.select("doc_id", F.posexplode(S.sentences(F.col("text"), F.col("lang"))).alias("position", "sentence"))


@query(r"""
WITH m AS (SELECT item_id, regexp_replace(trim(text), '([.!?][”’"'')]*)\s+([“‘"''(]?\p{Lu})', '\1' || chr(1) || '\2', 'g') AS x FROM benchmark),
s AS (SELECT item_id, list_filter(string_split(x, chr(1)), lambda x: x <> '') AS parts FROM m)
SELECT item_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS position FROM s""")
def verse_split(t):
    return t.benchmark.select("item_id", F.posexplode(S.verses(F.col("text"))).alias("position", "sentence"))


@query("""
WITH w AS (SELECT doc_id, text, instr(text, ', ') AS a, length(text) // 2 AS h FROM documents)
SELECT doc_id, length(text) AS plain_length, CASE WHEN a > 0 THEN a + 1 ELSE h END AS first_offset, CASE WHEN a > 0 THEN greatest(h, a + 1) ELSE h END AS last_offset, CASE WHEN a > 0 THEN 2 ELSE 1 END AS n_markers FROM w""")
def marker_offsets(t):
    """Marks behind the first comma and near the middle of texts, lifted out again."""
    comma, half = F.instr("text", ", "), F.floor(F.char_length("text") / 2).cast("int")
    middle = F.when(comma > 0, F.greatest(half, comma + 1)).otherwise(half)
    head, tail = F.substring("text", F.lit(1), middle), F.substring("text", middle + 1, F.char_length("text"))
    first = F.when(comma > 0, F.concat(F.substring(head, F.lit(1), comma + 1), F.format_string("{{{%d}}} ", "doc_id"), F.substring(head, comma + 2, F.char_length(head)))).otherwise(head)
    marked = F.concat(first, F.format_string("{{p%d}} ", "doc_id"), tail)
    lifted = t.documents.select("doc_id", markdown.markers(marked).alias("x"))
    return lifted.select("doc_id", F.char_length("x.text").alias("plain_length"), F.col("x.markers")[0]["char_offset"].alias("first_offset"), F.element_at("x.markers", -1)["char_offset"].alias("last_offset"), F.size("x.markers").alias("n_markers"))


@query("""
SELECT o_orderkey, count(*) AS n_items, sum(l_partkey) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def json_roundtrip(t):
    nested = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    text = t.orders.join(nested, F.col("o_orderkey") == F.col("l_orderkey")).select(F.to_json(F.struct("o_orderkey", "items")).alias("j"))
    back = text.select(F.from_json("j", "o_orderkey bigint, items array<struct<l_linenumber:int,l_partkey:bigint>>").alias("x")).select("x.o_orderkey", F.explode("x.items").alias("i"))
    return back.groupBy("o_orderkey").agg(F.count("*").alias("n_items"), F.sum("i.l_partkey").alias("parts"))


@query("""
SELECT p_partkey, p_brand || ' and ' || p_type || ' ' || CASE WHEN p_size % 3 = 0 THEN 'n.d.' WHEN p_size % 3 = 1 THEN CAST(1900 + p_size AS VARCHAR) ELSE '[' || CAST(1800 + p_size AS VARCHAR) || '] ' || CAST(1900 + p_size AS VARCHAR) END AS citation FROM part""")
def inline_citations(t):
    published = F.when(F.col("p_size") % 3 != 0, 1900 + F.col("p_size"))
    original = F.when(F.col("p_size") % 3 == 2, 1800 + F.col("p_size"))
    return t.part.select("p_partkey", X.cite_inline(F.array("p_brand", "p_type"), original, published).alias("citation"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
g AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM l)
SELECT doc_id, b AS block, string_agg(trim(line), ' ' ORDER BY n) AS paragraph FROM g WHERE trim(line) <> '' GROUP BY 1, 2""")
def paragraph_blocks(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("blank", F.trim("line") == "")
    blocks = lines.withColumn("block", F.sum(F.col("blank").cast("long")).over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).filter("not blank")
    return blocks.groupBy("doc_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim("line").alias("x")))), lambda x: x["x"]), " ").alias("paragraph"))
