"""Reading views: filters by viewer and parameter, computed join keys, sequences, sorts and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import hierarchy as T
from ..operators import numbering as N
from ..operators import predicates as P
from .tables import query


@query("SELECT doc_id, CAST(NULL AS VARCHAR) AS lang, source FROM documents")
def hidden_columns(t):
    return P.shown_if(t.documents.select("doc_id", "lang", "source"), ["lang"], False)


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_brand END, p_name) AS title, coalesce(CASE WHEN p_size % 2 = 0 THEN 1800 + p_size END, 1900 + p_size) AS year FROM part")
def title_and_year_fallback(t):
    title, year = F.when(F.col("p_size") > 25, F.col("p_brand")), F.when(F.col("p_size") % 2 == 0, 1800 + F.col("p_size"))
    return t.part.select("p_partkey", F.coalesce(title, "p_name").alias("title"), F.coalesce(year, 1900 + F.col("p_size")).alias("year"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def optional_filters(t):
    return P.optional(t.orders, {"o_orderstatus": "F", "o_custkey": None, "o_orderpriority": "1-URGENT"}).select("o_orderkey")


@query("SELECT 'some' AS asked, c_custkey FROM customer WHERE c_nationkey IN (1, 3, 5) UNION ALL SELECT 'joined', c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def set_membership(t):
    def asked(name, values):
        return P.among(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", values).select(F.lit(name).alias("asked"), "c_custkey")

    return asked("some", [1, 3, 5]).union(asked("none", [])).union(asked("joined", t.nation.filter("n_regionkey = 2").select("n_nationkey")))


_SEEN = """SELECT '{name}' AS viewer, event_id FROM (SELECT event_id, user_id, value > 90 AS archived, CASE WHEN event_type = 'view' THEN 'approved' WHEN event_type = 'purchase' THEN 'pending' ELSE 'rejected' END AS status FROM events)
WHERE NOT archived AND (status = 'approved' OR (user_id = {viewer} AND status = 'pending'))"""


@query(_SEEN.format(name="seven", viewer="7") + " UNION ALL " + _SEEN.format(name="nobody", viewer="CAST(NULL AS BIGINT)"))
def visible_to_viewer(t):
    status = F.when(F.col("event_type") == "view", "approved").when(F.col("event_type") == "purchase", "pending").otherwise("rejected")

    def seen(name, viewer):
        return t.events.filter(P.visible(status, F.col("user_id"), viewer, F.col("value") > 90)).select(F.lit(name).alias("viewer"), "event_id")

    return seen("seven", F.lit(7)).union(seen("nobody", F.lit(None).cast("long")))


@query(r"""
SELECT 'escaped' AS way, p_partkey FROM part WHERE contains(lower(p_type || '_' || p_brand), lower('_BRAND')) UNION ALL SELECT 'pattern', p_partkey FROM part WHERE p_type || '_' || p_brand ILIKE '%_a_%#1%'""")
def contains_search(t):
    column = F.concat("p_type", F.lit("_"), "p_brand")
    some = [t.part.filter(P.contains(column, text, escaped)).select(F.lit(way).alias("way"), "p_partkey") for way, text, escaped in (("escaped", "_BRAND", True), ("pattern", "_a_%#1", False))]
    return some[0].union(some[1])


@query("""
SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = CASE WHEN o_orderstatus = 'F' THEN o_custkey WHEN o_orderstatus = 'O' THEN o_custkey // 2 ELSE NULL END""")
def case_keyed_left_join(t):
    branches = [(F.col("o_orderstatus") == "F", [F.col("o_custkey")]), (F.col("o_orderstatus") == "O", [F.floor(F.col("o_custkey") / 2)])]
    return P.case_keyed(t.orders, t.customer.select("c_custkey", "c_name"), branches, ["c_custkey"]).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def restricted_left_join(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return P.restricted_left(t.orders.select("o_orderkey"), lines, ["o_orderkey"], "l_suppkey", t.supplier.filter("s_nationkey < 5").select("s_suppkey")).select("o_orderkey", "l_linenumber", "l_partkey")


@query("""
WITH h AS (SELECT DISTINCT p_brand AS page, rtrim(lower(p_name), ' .,;:!?') AS h, p_name FROM part), l AS (SELECT p_brand AS page, rtrim(lower(p_name || ' ' || p_type), ' .,;:!?') AS l, p_name || ' ' || p_type AS label, p_partkey FROM part)
SELECT h.page, p_name AS heading, min_by(label, p_partkey) AS label FROM h JOIN l ON h.page = l.page AND (starts_with(l, h) OR starts_with(h, l) OR (length(h) >= 10 AND contains(l, h))) WHERE length(h) >= 3 GROUP BY 1, 2""")
def fuzzy_heading_match(t):
    headings = t.part.select(F.col("p_brand").alias("page"), F.col("p_name").alias("heading")).distinct()
    labels = t.part.select(F.col("p_brand").alias("page"), F.concat_ws(" ", "p_name", "p_type").alias("label"), "p_partkey")
    return P.text_matches(headings, labels, ["page"], "heading", "label", "p_partkey")


@query("SELECT s_suppkey, coalesce((SELECT list(DISTINCT l_linestatus ORDER BY l_linestatus) FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50), CAST([] AS VARCHAR[])) AS states FROM supplier")
def array_subquery_default(t):
    lists = t.lineitem.filter("l_quantity = 50").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_linestatus")).alias("states"))
    joined = t.supplier.join(lists, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return joined.select("s_suppkey", F.coalesce("states", F.array().cast("array<string>")).alias("states"))


@query("""
SELECT o_custkey, o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) AS margin_number
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""")
def margin_note_numbers(t):
    """Notes numbered through a book by node, block, sentence, place and identity of what they hang on."""
    notes = t.lineitem.filter("l_returnflag = 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    order = ["o_orderdate", "o_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return N.renumber(notes, ["o_custkey"], order, "margin_number").select("o_custkey", "o_orderkey", "l_linenumber", "margin_number")


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS verse_number FROM lineitem")
def verse_book_renumber(t):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return N.renumber(t.lineitem.select("l_returnflag", *order), ["l_returnflag"], order, "verse_number").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "verse_number")


@query("""
SELECT o_custkey, month, first_order, row_number() OVER (PARTITION BY o_custkey ORDER BY first_order) AS ordinal FROM (SELECT o_custkey, month(o_orderdate) AS month, min(o_orderkey) AS first_order FROM orders GROUP BY 1, 2)""")
def canonical_ordinals(t):
    groups = t.orders.groupBy("o_custkey", F.month("o_orderdate").cast("long").alias("month")).agg(F.min("o_orderkey").alias("first_order"))
    return N.renumber(groups, ["o_custkey"], ["first_order"], "ordinal")


@query("""
SELECT conv_id, turn, nullif(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING), 0) AS segment FROM conversations""")
def running_segments(t):
    return P.running_segments(t.conversations, ["conv_id"], ["turn", "role", "text"], F.col("role") == "user", "segment").select("conv_id", "turn", "segment")


@query("""
WITH p AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 494 ORDER BY o_orderkey LIMIT 25)
SELECT *, (SELECT count(*) > 25 FROM orders WHERE o_orderkey > 494) AS has_more, (SELECT min(o_orderkey) FROM orders) < (SELECT min(o_orderkey) FROM p) AS has_previous FROM p""")
def anchored_page(t):
    return P.anchored_page(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 5, 20)


@query("""
SELECT p_brand, list(p_partkey ORDER BY lower(p_name), p_name, p_partkey) AS by_name, list(p_partkey ORDER BY CASE WHEN p_size % 3 <> 0 THEN 1900 + p_size END ASC NULLS LAST, p_partkey) AS undated_last,
list(p_partkey ORDER BY p_size % 5 <> 0, p_type, p_partkey) AS original_first FROM part GROUP BY 1""")
def reading_sorts(t):
    year = F.when(F.col("p_size") % 3 != 0, 1900 + F.col("p_size"))
    rows = t.part.select("p_brand", F.struct(F.lower("p_name"), "p_name", "p_partkey").alias("a"), F.struct(year.isNull(), year, "p_partkey").alias("b"), F.struct(F.col("p_size") % 5 != 0, "p_type", "p_partkey").alias("c"))
    sorted_keys = [F.transform(F.array_sort(F.collect_list(k)), lambda x: x["p_partkey"]).alias(n) for k, n in (("a", "by_name"), ("b", "undated_last"), ("c", "original_first"))]
    return rows.groupBy("p_brand").agg(*sorted_keys)


@query("""
WITH a AS (SELECT conv_id, turn AS v FROM conversations), b AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN turn + 1 ELSE turn END AS v FROM conversations),
n AS (SELECT conv_id, v, sum(s) AS s FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 AS s FROM b) GROUP BY 1, 2) SELECT conv_id, bool_and(s = 0) AS same FROM n GROUP BY 1""")
def permutation_check(t):
    old = t.conversations.select("conv_id", F.col("turn").alias("v"))
    new = t.conversations.select("conv_id", F.when(F.col("conv_id") % 3 == 0, F.col("turn") + 1).otherwise(F.col("turn")).alias("v"))
    return P.is_permutation(old, new, ["conv_id"], "v")


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_partkey // 4 END, p_partkey) AS work FROM part")
def one_hop_work_root(t):
    return t.part.select("p_partkey", F.coalesce(F.when(F.col("p_partkey") % 4 != 0, F.floor(F.col("p_partkey") / 4)), "p_partkey").alias("work"))


_CYCLES = """
WITH RECURSIVE e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 3 THEN p_partkey + 1 WHEN p_partkey % 50 = 4 THEN p_partkey + 1 WHEN p_partkey % 50 = 5 THEN p_partkey - 2 WHEN p_partkey % 50 <> 0 THEN p_partkey - 1 END AS p FROM part),
w AS (SELECT k AS start, k AS spot, 0 AS step FROM e UNION ALL SELECT start, e.p AS spot, step + 1 FROM w JOIN e ON e.k = w.spot JOIN part ON p_partkey = e.p WHERE step < 60),
"""


@query(_CYCLES + """
v AS (SELECT start, spot, min(step) AS first, count(*) AS n FROM w GROUP BY 1, 2), c AS (SELECT start, min(first) AS first FROM v WHERE n > 1 GROUP BY 1), z AS (SELECT start, max(first) AS last FROM v GROUP BY 1)
SELECT v.start AS p_partkey, v.spot AS root FROM v LEFT JOIN c USING (start) JOIN z USING (start) WHERE v.first = coalesce(c.first, z.last)""")
def roots_with_cycles(t):
    """Chains of up to 44 parts above three-part cycles, and others that end: a walk that meets a node again ends there."""
    return T.roots(_cycles(t), "p_partkey", "parent").select("p_partkey", "root")


@query(_CYCLES + "v AS (SELECT start, spot, count(*) AS n FROM w GROUP BY 1, 2) SELECT DISTINCT start AS p_partkey FROM v WHERE n > 1")
def endless_nodes(t):
    return T.cyclic(_cycles(t), "p_partkey", "parent")


def _cycles(t):
    k = F.col("p_partkey")
    return t.part.select(k, F.when((k % 50).isin(3, 4), k + 1).when(k % 50 == 5, k - 2).when(k % 50 != 0, k - 1).alias("parent"))


@query("""
WITH g AS (SELECT s_nationkey AS top, s_suppkey, s_suppkey % 3 = 0 AS compiled FROM supplier)
SELECT s_suppkey, CASE WHEN compiled THEN 'nation ' || top ELSE 'supplier ' || s_suppkey END AS card, count(*) OVER (PARTITION BY CASE WHEN compiled THEN 'nation ' || top ELSE 'supplier ' || s_suppkey END) AS versions FROM g""")
def group_routing(t):
    """Members of a compilation share its card, others have their own; a card counts its versions."""
    card = F.when(F.col("s_suppkey") % 3 == 0, F.format_string("nation %d", "s_nationkey")).otherwise(F.format_string("supplier %d", "s_suppkey"))
    return t.supplier.select("s_suppkey", card.alias("card")).withColumn("versions", F.count("*").over(Window.partitionBy("card")))


@query("SELECT doc_id, strlen(s) AS n_bytes, s AS snippet FROM (SELECT doc_id, list_max(list_filter(range(1, 201), lambda i: strlen(text[1:i]) <= 200)) AS m, text FROM documents) , LATERAL (SELECT coalesce(text[1:m], '') AS s)")
def byte_bounded_snippet(t):
    found = t.documents.select("doc_id", P.snippet(F.col("text"), 200).alias("snippet"))
    return found.select("doc_id", F.octet_length("snippet").cast("long").alias("n_bytes"), "snippet")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, year(ts) AS year, epoch_us(ts) // 1000000 AS seconds FROM events")
def timestamps_rendered(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.year(ts).cast("long").alias("year"), F.unix_seconds(ts).alias("seconds"))


@query("SELECT l_suppkey, min(l_partkey) AS left, min(l_quantity) AS top, max(l_partkey) - min(l_partkey) AS width, max(l_quantity) - min(l_quantity) AS height FROM lineitem GROUP BY 1")
def bounding_boxes(t):
    return P.boxes(t.lineitem, ["l_suppkey"], "l_partkey", "l_quantity")


@query("""
WITH f AS (SELECT o_custkey, o_orderpriority AS k, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1, 2) SELECT o_custkey, string_agg(k || '=' || v, ',' ORDER BY k) AS attributes FROM f GROUP BY 1""")
def first_wins_attributes(t):
    maps = P.first_wins(t.orders, ["o_custkey"], "o_orderpriority", "o_orderkey", ["o_orderdate", "o_orderkey"])
    return maps.select("o_custkey", F.array_join(F.transform(F.map_entries("attributes"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("attributes"))


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 10000000, o_custkey, 'O' FROM orders o WHERE o_orderkey % 9 = 0
AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'O') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def partial_conflict_insert(t):
    """New rows conflict only with those that a partial index holds: the open orders of the same customer."""
    from ..operators.mutations import insert_missing

    some = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    new = some.filter("o_orderkey % 9 = 0").groupBy("o_custkey").agg((F.min("o_orderkey") + 10_000_000).alias("o_orderkey")).withColumn("o_orderstatus", F.lit("O"))
    added = insert_missing(some.filter("o_orderstatus = 'O'"), new.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"]).filter("o_orderkey > 10000000")
    return some.unionByName(added)


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' ELSE 'simple' END AS config, lower(source) || ':' || n_chars AS derived FROM documents")
def derived_at_write(t):
    """The text-search configuration of a language, from a dimension in code, and a derived column, as computed when rows are written."""
    configs = t.spark.createDataFrame([("en", "english"), ("de", "german"), ("fr", "french"), ("es", "spanish")], "lang string, config string")
    joined = t.documents.select("doc_id", "lang", "source", "n_chars").join(F.broadcast(configs), "lang", "left")
    return joined.select("doc_id", F.coalesce("config", F.lit("simple")).alias("config"), F.concat_ws(":", F.lower("source"), F.col("n_chars").cast("string")).alias("derived"))


@query("""
WITH q AS (SELECT c_custkey, c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 1 ELSE 2 END AS most FROM customer)
SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(n, 0) < most AS may_add FROM q LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def role_limits(t):
    limits = t.spark.createDataFrame([("BUILDING", 3), ("MACHINERY", 1)], "c_mktsegment string, most int")
    counted = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = t.customer.join(F.broadcast(limits), "c_mktsegment", "left").join(counted, F.col("c_custkey") == F.col("o_custkey"), "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return rows.select("c_custkey", n.alias("n_orders"), (n < F.coalesce("most", F.lit(2))).alias("may_add"))


@query("""
WITH l AS (SELECT l_orderkey, list({'n': l_linenumber, 'p': l_partkey} ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey, list({'k': o_orderkey, 'items': items} ORDER BY o_orderkey) AS orders FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY 1),
c AS (SELECT c_nationkey, list({'c': c_custkey, 'orders': orders} ORDER BY c_custkey) AS customers FROM customer JOIN o ON o_custkey = c_custkey GROUP BY 1)
SELECT n_nationkey, CAST(to_json({'name': n_name, 'customers': customers}) AS VARCHAR) AS page FROM nation JOIN c ON c_nationkey = n_nationkey""")
def nested_page(t):
    """A page of four levels as JSON: nation, customers, orders, items; each level is gathered under its parent's key before it meets the next."""
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")))).alias("items"))
    orders = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), "items"))).alias("orders"))
    customers = t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("c"), "orders"))).alias("customers"))
    return t.nation.join(customers, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), "customers")).alias("page"))
