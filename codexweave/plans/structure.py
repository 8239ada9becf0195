"""Document structure: numbering, keys, hashes, intervals, trees and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as X
from ..operators import hierarchy as T
from ..operators import numbering as N
from ..operators import ranges as A
from .tables import query

_ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(f"SELECT l_suppkey, {_ROW.replace('l_suppkey, ', '')}, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ROW}) AS sentence_number FROM lineitem")
def global_dense_renumber(t):
    return N.renumber(t.lineitem, ["l_suppkey"], _ROW.split(", "), "sentence_number").select(*_ROW.split(", "), "sentence_number")


@query("""
SELECT o_custkey, o_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS note_number
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N'""")
def footnote_style_renumber(t):
    notes = t.lineitem.filter("l_returnflag = 'N'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return N.renumber(notes, ["o_custkey"], ["o_orderdate", "o_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], "note_number").select("o_custkey", "o_orderkey", "l_linenumber", "l_partkey", "l_quantity", "note_number")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS position FROM conversations")
def dense_positions(t):
    return N.renumber(t.conversations, ["conv_id"], ["turn", "role"], "position", start=0).select("conv_id", "turn", "role", "position")


@query("""
SELECT doc_id, line_number, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents) WHERE trim(line) <> ''""")
def line_blocks_numbered(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("line_number"), "line").filter("trim(line) <> ''")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
m AS (SELECT *, sum(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM l)
SELECT doc_id, g AS stanza, count(*) AS n_lines, min(n) AS first_line, max(n) AS last_line FROM m WHERE length(line) >= 60 GROUP BY 1, 2""")
def stanza_islands(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("n", (F.col("p") + 1).cast("long"))
    return N.islands(lines, ["doc_id"], ["n"], F.char_length("line") < 60, "stanza").groupBy("doc_id", "stanza").agg(F.count("*").alias("n_lines"), F.min("n").alias("first_line"), F.max("n").alias("last_line"))


@query("""
SELECT o_orderkey, 'o' || o_orderkey || '.l' || l_linenumber AS natural_key, count(*) AS n FROM orders JOIN lineitem ON 'o' || o_orderkey = 'o' || l_orderkey GROUP BY 1, 2""")
def natural_key_join(t):
    items = t.lineitem.withColumn("k", F.format_string("o%d", "l_orderkey")).withColumn("natural_key", F.format_string("o%d.l%d", "l_orderkey", "l_linenumber"))
    return t.orders.withColumn("k", F.format_string("o%d", "o_orderkey")).join(items, "k").groupBy("o_orderkey", "natural_key").agg(F.count("*").alias("n"))


_HASH = """
SELECT o_orderkey, sha256(o_orderstatus || chr(31) || o_orderpriority || chr(31) || coalesce('S' || nullif(o_custkey % 7, 0) || chr(31), 'N' || chr(31)) || n || chr(31) || items) AS content_hash
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_partkey || chr(31) || l_returnflag || chr(31), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS items FROM {lines} GROUP BY 1) ON l_orderkey = o_orderkey WHERE n IS NOT NULL"""


def _hashed(orders, lines):
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.concat(H.field(F.col("l_partkey")), H.field(F.col("l_returnflag"))).alias("e"))
    items = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("items"))
    encoded = F.concat(H.field(F.col("o_orderstatus")), H.field(F.col("o_orderpriority")), H.optional(F.nullif(F.col("o_custkey") % 7, F.lit(0))), H.listed(F.col("items")))
    return orders.join(items, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", H.digest(encoded).alias("content_hash"))


@query(_HASH.format(lines="lineitem"))
def content_hash_nodes(t):
    return _hashed(t.orders, t.lineitem)


_NEW = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 10 = 3 THEN 'X' ELSE l_returnflag END AS l_returnflag FROM lineitem WHERE l_orderkey % 50 <> 7)"


@query(f"""
WITH a AS ({_HASH.format(lines='lineitem')}), b AS ({_HASH.format(lines=_NEW)})
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.content_hash IS DISTINCT FROM b.content_hash""")
def changed_nodes(t):
    new = t.lineitem.filter("l_orderkey % 50 <> 7").withColumn("l_returnflag", F.when(F.col("l_orderkey") % 10 == 3, "X").otherwise(F.col("l_returnflag")))
    return N.changes(_hashed(t.orders, t.lineitem), _hashed(t.orders, new), "o_orderkey", "content_hash")


@query("""
WITH s AS (SELECT l_orderkey, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s.l_orderkey, low, high, l_partkey, l_linenumber FROM s JOIN lineitem l ON s.l_orderkey = l.l_orderkey AND l_linenumber BETWEEN low AND high""")
def canonical_projection(t):
    spans = A.span(t.lineitem.filter("l_returnflag = 'R'"), ["l_orderkey"], F.col("l_linenumber"))
    points = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
    return A.overlap_join(spans, points, ["l_orderkey"], ("low", "high"), ("l_linenumber", "l_linenumber"), 8).select("l_orderkey", "low", "high", "l_partkey", "l_linenumber")


@query("""
WITH s AS (SELECT l_suppkey, l_orderkey, min(epoch_us(l_shipdate) // 86400000000) AS low, max(epoch_us(l_shipdate) // 86400000000) AS high FROM lineitem GROUP BY 1, 2),
w AS (SELECT s_suppkey, 9000 + s_suppkey * 3 AS start, 9020 + s_suppkey * 3 AS stop FROM supplier)
SELECT l_suppkey, l_orderkey, low, high, start, stop FROM s JOIN w ON l_suppkey = s_suppkey AND low <= stop AND high >= start""")
def range_overlap(t):
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86_400_000_000)
    spans = A.span(t.lineitem, ["l_suppkey", "l_orderkey"], day)
    windows = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (9000 + F.col("s_suppkey") * 3).alias("start"), (9020 + F.col("s_suppkey") * 3).alias("stop"))
    return A.overlap_join(spans, windows, ["l_suppkey"], ("low", "high"), ("start", "stop"), 64).select("l_suppkey", "l_orderkey", "low", "high", "start", "stop")


@query("""
SELECT e.event_id, e.user_id, (SELECT max_by(v.event_id, (v.ts, v.event_id)) FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.ts <= e.ts) AS last_view
FROM events e WHERE e.event_type = 'purchase'""")
def asof_backward(t):
    bought, seen = t.events.filter("event_type = 'purchase'"), t.events.filter("event_type = 'view'").withColumn("seen", F.col("event_id"))
    return A.asof_backward(bought.select("event_id", "user_id", "ts"), seen, ["user_id"], ["ts"], "seen", "last_view").select("event_id", "user_id", "last_view")


@query("""
WITH m AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey + 100 END AS c FROM nation WHERE n_nationkey % 2 = 0)
SELECT c_custkey, c_nationkey, CASE WHEN m.k IS NULL THEN c_nationkey ELSE m.c END AS canonical FROM customer LEFT JOIN m ON c_nationkey = m.k""")
def alignment_three_state(t):
    mapping = t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") + 100).alias("c"))
    return A.three_state(t.customer.select("c_custkey", "c_nationkey"), mapping, [], "c_nationkey", "c", "canonical")


@query("""
WITH c AS (SELECT p_brand AS unit, count(DISTINCT p_size) AS here, count(DISTINCT p_type) AS there FROM part GROUP BY 1), v AS (SELECT unit, here - there AS shift, unnest(range(1, here + 1)) AS local_ref FROM c WHERE here > there)
SELECT unit, local_ref, CASE WHEN local_ref > shift THEN local_ref - shift END AS canonical_ref FROM v""")
def verse_shift_alignment(t):
    counts = t.part.groupBy(F.col("p_brand").alias("unit")).agg(F.count_distinct("p_size").alias("here"), F.count_distinct("p_type").alias("there"))
    return A.shift_alignment(counts, "unit", "here", "there")


@query("""
WITH n AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b, n_nationkey FROM nation)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'customer ' || c_custkey WHEN n_nationkey % 2 = 0 THEN 'nation ' || n_nationkey WHEN a <> 'r1' THEN 'region ' || a END AS source
FROM customer JOIN n ON c_nationkey = n_nationkey""")
def effective_ancestor_value(t):
    region, nation = F.format_string("r%d", "n_regionkey"), F.format_string("n%d", "n_nationkey")
    leaves = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.array(region, nation, F.format_string("c%d", "c_custkey")).alias("path"))
    tops = t.nation.select(F.array(region).alias("path"), F.when(region != "r1", F.concat(F.lit("region "), region)).alias("v")).distinct()
    middle = t.nation.select(F.array(region, nation).alias("path"), F.when(F.col("n_nationkey") % 2 == 0, F.format_string("nation %d", "n_nationkey")).alias("v"))
    own = leaves.select("path", F.when(F.col("c_custkey") % 3 == 0, F.format_string("customer %d", "c_custkey")).alias("v"))
    return T.effective(leaves, tops.union(middle).union(own), "path", "v", "source").select("c_custkey", "source")


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey // 3 END AS p FROM part), c AS (SELECT k, k AS top, p FROM e UNION ALL SELECT c.k, e.k AS top, e.p FROM c JOIN e ON c.p = e.k)
SELECT k AS p_partkey, top AS root FROM c WHERE p IS NULL""")
def root_chase(t):
    edges = t.part.select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.floor(F.col("p_partkey") / 3)).alias("parent"))
    return T.roots(edges, "p_partkey", "parent").select("p_partkey", "root")


@query("""
SELECT r_regionkey, r_name, n_nations, nations FROM region JOIN (SELECT n_regionkey, count(*) AS n_nations, string_agg(n_name || '(' || coalesce(s, '') || ')', ';' ORDER BY n_nationkey) AS nations
FROM nation LEFT JOIN (SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_suppkey) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY 1) ON n_regionkey = r_regionkey""")
def nested_assembly(t):
    inner = t.supplier.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("s"))
    named = F.concat("n_name", F.lit("("), F.array_join(F.coalesce(F.transform("s", lambda x: x["s_name"]), F.array().cast("array<string>")), ","), F.lit(")"))
    outer = t.nation.join(inner, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey").agg(F.count("*").alias("n_nations"), F.array_sort(F.collect_list(F.struct("n_nationkey", named.alias("x")))).alias("c"))
    return t.region.join(outer, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name", "n_nations", F.array_join(F.transform("c", lambda x: x["x"]), ";").alias("nations"))


@query("""
WITH g AS (SELECT user_id, event_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
m AS (SELECT user_id, median(gap) AS mid FROM g GROUP BY 1)
SELECT g.user_id, event_id, sum(CASE WHEN gap > 1.5 * mid THEN 1 ELSE 0 END) OVER (PARTITION BY g.user_id ORDER BY ts, event_id) AS paragraph FROM g JOIN m ON g.user_id = m.user_id""")
def median_gap_groups(t):
    return N.gap_groups(t.events, ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"], 1.5, "paragraph").select("user_id", "event_id", "paragraph")


@query(r"SELECT doc_id, lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS normal FROM documents")
def normalise_text(t):
    return t.documents.select("doc_id", X.normalise(F.col("text")).alias("normal"))


@query("""
WITH n AS (SELECT item_id, trim(regexp_replace(lower(text), '[^!-~]+', ' ', 'g')) AS x FROM benchmark)
SELECT a.item_id, round(1 - levenshtein(a.x, b.x) / greatest(length(a.x), length(b.x)), 6) AS ratio FROM n a JOIN n b ON b.item_id = a.item_id + 1""")
def similarity_ratio(t):
    items = t.benchmark.select("item_id", F.regexp_replace(F.lower("text"), "[^!-~]+", " ").alias("x"))
    following = items.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y"))
    return items.join(following, "item_id").select("item_id", F.round(X.similarity(F.col("x"), F.col("y")), 6).alias("ratio"))


@query("""
SELECT doc_id, item_id FROM documents JOIN benchmark b ON contains(' ' || trim(regexp_replace(lower(documents.text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(b.text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ')""".replace("\\\\", "\\"))
def quote_containment(t):
    """Quotes meet texts by their first eight words, hashed, instead of each with each."""
    forms = t.documents.select("doc_id", X.contained_form(F.col("text")).alias("form"))
    quotes = t.benchmark.select("item_id", X.contained_form(F.col("text")).alias("quote"))
    return N.contained(forms, quotes, "form", "quote", "doc_id").select("doc_id", "item_id")


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugify(t):
    return t.part.select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("""
SELECT p_partkey, CASE WHEN p_name LIKE '% %' THEN regexp_extract(p_name, '([^ ]+)$', 1) || ', ' || regexp_replace(p_name, ' +[^ ]+$', '') ELSE p_name END AS sort_name FROM part""")
def sort_name(t):
    return t.part.select("p_partkey", X.sort_name(F.col("p_name")).alias("sort_name"))


@query(r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS x FROM documents), h AS (SELECT *, x[1:300] AS head FROM f), c AS (SELECT *, length(head) - length(regexp_extract(head, '[^ ]*$')) AS s FROM h)
SELECT doc_id, CASE WHEN length(x) <= 300 THEN x ELSE regexp_replace(CASE WHEN s - 1 > 150 THEN head[1:s - 1] ELSE head END, '[,;: ]+$', '') || '…' END AS excerpt FROM c""")
def excerpt(t):
    return t.documents.select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


@query(r"SELECT p_partkey, replace(replace(replace(p_brand || '_' || p_type || '%', '\', '\\'), '%', '\%'), '_', '\_') AS pattern FROM part")
def like_escape(t):
    return t.part.select("p_partkey", X.like_escaped(F.concat("p_brand", F.lit("_"), "p_type", F.lit("%"))).alias("pattern"))


@query(r"""
SELECT doc_id, n, sentence FROM (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?…]+)[ \n\t]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)) WHERE sentence <> ''""")
def sentence_split_simple(t):
    parts = F.split(F.regexp_replace("text", r"([.!?…]+)[ \n\t]+", "$1\u0001"), "\u0001")
    return t.documents.select("doc_id", F.posexplode(parts).alias("p", "sentence")).select("doc_id", (F.col("p") + 1).cast("long").alias("n"), "sentence").filter("sentence <> ''")


@query("""
SELECT s_suppkey, 'G' || (s_suppkey // 10) AS a, 'S' || s_suppkey AS b FROM supplier WHERE s_suppkey % 10 <> 0""")
def depth_coded_paths(t):
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 10 == 0, 0).otherwise(1).alias("depth"), F.when(F.col("s_suppkey") % 10 == 0, F.format_string("G%d", F.floor(F.col("s_suppkey") / 10))).otherwise(F.format_string("S%d", "s_suppkey")).alias("label"), F.floor(F.col("s_suppkey") / 10).alias("book"))
    out = T.paths(rows, ["book"], ["s_suppkey"], "depth", "label")
    return out.filter("depth = 1").select("s_suppkey", F.get("path", F.lit(0)).alias("a"), F.get("path", F.lit(1)).alias("b"))


@query("""
SELECT p_partkey, label, CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 THEN p_size ELSE -10000 + 10 * (1 + p_size // 10) + 6 END AS page_order
FROM (SELECT p_partkey, p_size, CASE p_size % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || 'b' ELSE repeat('x', CAST(1 + p_size // 10 AS INT)) || 'vi' END AS label FROM part)""")
def page_labels_order(t):
    """Numbers, numbers with a letter, and Roman numerals, which come before all numbers."""
    size = F.col("p_size")
    label = F.when(size % 3 == 0, size.cast("string")).when(size % 3 == 1, F.concat(size.cast("string"), F.lit("b"))).otherwise(F.concat(F.repeat(F.lit("x"), (1 + F.floor(size / 10)).cast("int")), F.lit("vi")))
    return t.part.select("p_partkey", label.alias("label")).withColumn("page_order", X.page_order(F.col("label")))


@query("""
SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations""")
def cumulative_offsets(t):
    window = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    return t.conversations.select("conv_id", "turn", F.sum(F.char_length("text") + 1).over(window).alias("before"))
