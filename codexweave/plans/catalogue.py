"""Catalogue queries: joins, counts, flags, pages, set operations and windows on the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from .tables import query


@query("""
SELECT c_custkey, (SELECT string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderdate, o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS order_list
FROM customer""")
def catalog_ordered_listagg(t):
    out = R.ordered_list(t.customer, t.orders, F.col("c_custkey") == F.col("o_custkey"), ["o_custkey"], F.col("o_orderkey"), [F.col("o_orderdate"), F.col("o_orderkey")], "order_list")
    return out.select("c_custkey", "order_list")


@query("""
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_final, count(*) FILTER (o_totalprice > 250000) AS n_large, count(DISTINCT o_custkey) AS customers
FROM orders GROUP BY 1""")
def conditional_counts(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.count_if(F.col("o_totalprice") > 250000).alias("n_large"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def zero_preserving_counts(t):
    return R.counts_kept(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey", "n_orders")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_return FROM orders")
def has_child_flag(t):
    return R.flagged(t.orders.select("o_orderkey"), t.lineitem.filter("l_returnflag = 'R'"), "o_orderkey", "l_orderkey", "has_return")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def orphan_anti_join(t):
    return t.customer.join(t.orders.filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)
OR EXISTS (SELECT 1 FROM events WHERE event_id = o_orderkey AND event_type = 'error') OR EXISTS (SELECT 1 FROM part WHERE p_partkey = o_orderkey AND p_size < 5)""")
def or_of_exists(t):
    branches = [t.lineitem.filter("l_quantity = 50").select("l_orderkey"), t.events.filter("event_type = 'error'").select("event_id"), t.part.filter("p_size < 5").select("p_partkey")]
    return R.any_of(t.orders.select("o_orderkey"), "o_orderkey", branches)


@query("""
SELECT a.n_name AS customer_nation, b.n_name AS supplier_nation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2""")
def role_playing_dim(t):
    facts = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    counted = facts.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    a, b = t.nation.alias("a"), t.nation.alias("b")
    joined = counted.join(a, F.col("c_nationkey") == F.col("a.n_nationkey")).join(b, F.col("s_nationkey") == F.col("b.n_nationkey"))
    return joined.select(F.col("a.n_name").alias("customer_nation"), F.col("b.n_name").alias("supplier_nation"), "n")


@query("""
SELECT conv_id, turn, previous_turn, next_turn FROM (SELECT conv_id, turn, role, lag(turn) OVER w AS previous_turn, lead(turn) OVER w AS next_turn FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'assistant'""")
def prev_next_neighbours(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return t.conversations.select("conv_id", "turn", "role", F.lag("turn").over(w).alias("previous_turn"), F.lead("turn").over(w).alias("next_turn")).filter("role = 'assistant'").drop("role")


@query("SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_with_total(t):
    return R.with_total(t.orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 40, 20)


_PAGE = """
SELECT o_orderkey, o_orderdate, (SELECT count(*) > 20 FROM (SELECT 1 FROM orders WHERE o_orderkey {way} 700 LIMIT 21)) AS has_more FROM orders WHERE o_orderkey {way} 700 ORDER BY o_orderkey {order} LIMIT 20"""


@query(_PAGE.format(way=">", order="ASC"))
def keyset_page_forward(t):
    return R.keyset_page(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey", 700, 20)


@query(_PAGE.format(way="<", order="DESC"))
def keyset_page_backward(t):
    return R.keyset_page(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey", 700, 20, backward=True)


@query("""
SELECT c_custkey, max(o_orderdate) AS last_order, c_acctbal FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey, c_acctbal
ORDER BY last_order DESC NULLS LAST, c_acctbal DESC, c_custkey LIMIT 50""")
def nulls_last_sort_topk(t):
    pending = t.orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    joined = t.customer.join(pending, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last_order", "c_acctbal")
    return joined.orderBy(F.desc_nulls_last("last_order"), F.desc("c_acctbal"), "c_custkey").limit(50)


@query("""
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS last_24h FROM events""")
def rolling_24h_count(t):
    return R.trailing_counts(t.events, "user_id", "ts", 86_400, "last_24h").select("event_id", "user_id", "last_24h")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def event_dedup_upsert(t):
    return R.latest(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT count(*) AS n, coalesce(max(ts), TIMESTAMP '1970-01-01') AS latest FROM events")
def activity_stamp(t):
    return R.fingerprint(t.events, "ts")


@query("""
SELECT *, greatest(a, n, r) - least(a, n, r) AS drift FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r
FROM lineitem GROUP BY 1) WHERE a <> n OR n <> r""")
def pivot_drift(t):
    wide = t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count("l_orderkey")).na.fill(0).toDF("l_suppkey", "a", "n", "r")
    return wide.filter("a <> n or n <> r").withColumn("drift", F.greatest("a", "n", "r") - F.least("a", "n", "r"))


@query("""
SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS at FROM orders UNION ALL SELECT event_type AS kind, event_id AS id, ts AS at FROM events WHERE value > 50""")
def unified_feed(t):
    a = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return a.unionByName(t.events.filter("value > 50").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at")))


@query("""
WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 10 FROM labels)
SELECT 'left' AS side, * FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'right' AS side, * FROM (FROM b EXCEPT ALL FROM a)""")
def set_difference_both_ways(t):
    return R.both_ways(t.documents.select("doc_id"), t.labels.select("doc_id").union(t.labels.select(F.col("doc_id") + 10)))


@query("""
SELECT l_partkey, l_returnflag AS winner, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_returnflag DESC) AS k
FROM (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE k = 1""")
def majority_vote(t):
    return R.majority(t.lineitem, ["l_partkey"], "l_returnflag", "winner")


@query("""
SELECT quality, source, doc_id, n_chars, rank FROM (SELECT quality, source, doc_id, n_chars, row_number() OVER (PARTITION BY quality, source ORDER BY n_chars DESC, doc_id) AS rank
FROM labels JOIN documents USING (doc_id)) WHERE rank <= 3""")
def label_quota(t):
    joined = t.labels.join(t.documents.select("doc_id", "source", "n_chars"), "doc_id").select("quality", "source", "doc_id", "n_chars")
    return R.top_per_group(joined, ["quality", "source"], [F.desc("n_chars"), F.asc("doc_id")], 3)


@query("""
WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS l_suppkey, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def parity_check(t):
    return R.parity(t.lineitem.filter("l_linestatus = 'O'"), t.lineitem.filter("l_linestatus = 'F'"), ["l_suppkey"])


@query("SELECT count(DISTINCT doc_id) AS works, count(DISTINCT source) AS authors, count(DISTINCT lang) AS languages FROM documents")
def library_totals(t):
    return t.documents.agg(F.count_distinct("doc_id").alias("works"), F.count_distinct("source").alias("authors"), F.count_distinct("lang").alias("languages"))


@query("""
SELECT c_custkey, coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0) + coalesce((SELECT count(*) FROM events WHERE user_id = c_custkey), 0) AS dependents FROM customer""")
def dependents_count(t):
    rows = t.orders.select(F.col("o_custkey").alias("k")).union(t.events.select("user_id"))
    return R.counts_kept(t.customer.select("c_custkey"), rows, "c_custkey", "k", "dependents")


@query("""
SELECT s_suppkey, CASE WHEN length(s_name) <= 6 THEN s_name ELSE upper(n_name) END AS badge FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def badge_case(t):
    from ..functions.text import badge

    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", badge(F.col("s_name"), F.col("n_name")).alias("badge"))


@query("""
SELECT l_suppkey, list(DISTINCT l_returnflag || '/' || l_linestatus ORDER BY l_returnflag || '/' || l_linestatus) AS origins FROM lineitem GROUP BY 1""")
def distinct_origins(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.array_sort(F.collect_set(F.concat_ws("/", "l_returnflag", "l_linestatus"))).alias("origins"))


@query("""
SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_ref, nullif(max_by(o_orderkey, (o_orderdate, o_orderkey)), min_by(o_orderkey, (o_orderdate, o_orderkey))) AS last_ref
FROM orders GROUP BY 1""")
def first_last_refs(t):
    order = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", order).alias("first_ref"), F.nullif(F.max_by("o_orderkey", order), F.min_by("o_orderkey", order)).alias("last_ref"))
