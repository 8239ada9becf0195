"""Works and their words: bibliographies, passages by a book's numbering, embedded quotations, old spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as B
from ..operators import lexicon as L
from ..operators import library as C
from .tables import query


@query("""
SELECT p_partkey, CASE WHEN who = '' THEN '<em>' || p_name || '</em>. ' || y ELSE who || ' ' || y || ' <em>' || p_name || '</em>.' END || e || f AS entry FROM (SELECT p_partkey, p_name,
CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'Last, First' || s WHEN 2 THEN 'Last, First, and B C' || s ELSE 'Last, First, B C, and D E' || s END AS who,
CASE p_size % 5 WHEN 0 THEN 'n.d.' WHEN 1 THEN '(' || CAST(1800 + p_size AS VARCHAR) || ') ' || CAST(1900 + p_size AS VARCHAR) || '.' ELSE CAST(1900 + p_size AS VARCHAR) || '.' END AS y,
CASE WHEN p_size % 2 = 0 THEN ' 2nd ed..' ELSE '' END AS e, CASE p_partkey % 4 WHEN 0 THEN ' ' || p_type || ': ' || p_brand || '.' WHEN 1 THEN ' ' || p_brand || '.' WHEN 2 THEN ' ' || p_type || '.' ELSE '' END AS f
FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN ', eds.' ELSE '.' END AS s FROM part))""")
def bibliography(t):
    size, part = F.col("p_size"), F.col("p_partkey")
    names = [F.slice(F.array(*map(F.lit, names)), F.lit(1), size % 4) for names in (["Last, First", "C, B", "E, D"], ["First Last", "B C", "D E"])]
    role, original = F.when(part % 3 == 0, "eds."), F.when(size % 5 == 1, 1800 + size).when(size % 5 == 2, 1900 + size).when(size % 5 == 0, 1700)
    published, edition = F.when(size % 5 != 0, 1900 + size), F.when(size % 2 == 0, " 2nd ed. ").otherwise(" ")
    place, publisher = F.when(part % 2 == 0, F.col("p_type")), F.when(part % 4 < 2, F.col("p_brand")).otherwise("")
    return t.part.select("p_partkey", B.bibliography_entry(*names, role, original, published, F.col("p_name"), edition, place, publisher).alias("entry"))


@query("""
SELECT o_orderkey, CASE WHEN count(l_orderkey) = 0 THEN o_orderstatus || ' · s. ' || CAST(o_custkey AS VARCHAR)
ELSE string_agg(l_linestatus || ' ' || CAST(lo AS VARCHAR) || CASE WHEN hi <> lo THEN '–' || CAST(hi AS VARCHAR) ELSE '' END || ' in ' || o_orderstatus, ' · ' ORDER BY l_linestatus) END AS locator
FROM orders LEFT JOIN (SELECT l_orderkey, l_linestatus, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2) ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_custkey""")
def passage_locators(t):
    """First and last reference in each system, by the system's template; a node's label and sentence where there is no system."""
    spans = t.lineitem.filter("l_quantity > 10").groupBy("l_orderkey", "l_linestatus").agg(F.min("l_linenumber").cast("string").alias("first_ref"), F.max("l_linenumber").cast("string").alias("last_ref"))
    one = F.struct("l_linestatus", F.concat(F.lit(" {parent}"), "l_linestatus", F.lit(" {ref} in {self} ")).alias("template"), "first_ref", "last_ref")
    systems = spans.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("systems"))
    joined = t.orders.join(systems, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    where = B.passage_locator(F.coalesce("systems", F.array()), F.lit(None).cast("string"), F.col("o_orderstatus"), F.concat(F.lit("s. "), F.col("o_custkey").cast("string")))
    return joined.select("o_orderkey", where.alias("locator"))


@query("""
SELECT p_partkey, p_brand AS book, least(p_size, 25) AS first, nullif(greatest(p_size, 25), least(p_size, 25)) AS last, CASE p_partkey % 4 WHEN 0 THEN 'footnote' WHEN 1 THEN 'body' ELSE 'figure' END AS kind FROM part WHERE p_partkey % 4 <> 2
UNION ALL SELECT p_partkey, 'plain', p_size, NULL, 'body' FROM part""")
def quotation_directives(t):
    """Two good directives and two that are left out in each text, but for texts whose first names an unknown kind."""
    kind = F.when(F.col("p_partkey") % 4 == 0, ' kind="footnote"').when(F.col("p_partkey") % 4 == 1, "").when(F.col("p_partkey") % 4 == 2, ' kind="margin"').otherwise(' kind="figure" kind="none"')
    # A small table with much to read in each row: dealt over all tasks first.
    part = t.part.select("p_partkey", "p_brand", "p_size").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    texts = part.select("p_partkey", F.concat(F.lit('A ::quotation{book="'), "p_brand", F.lit('" end=25 start="'), F.col("p_size").cast("string"), F.lit('"'), kind, F.lit('}, ::quotation{start=3}, ::quotation{book="b" start="x"} and ::quotation{book="plain" end="?" start='), F.col("p_size").cast("string"), F.lit("}.")).alias("text"))
    found = texts.select("p_partkey", F.explode(B.quotation_directives(F.col("text"))).alias("d"))
    return found.select("p_partkey", "d.book", F.col("d.start").alias("first"), F.col("d.end").alias("last"), "d.kind")


_PAIRS = r"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[^a-zA-Z]+')) AS word FROM documents),
p AS (SELECT replace(word, 's', 'ſ') AS surface, CASE WHEN word LIKE 'e%' THEN replace(word, 's', 'ſ') WHEN doc_id % 3 = 0 THEN replace(word, 'th', 't') WHEN doc_id % 3 = 1 THEN replace(replace(word, 'th', 't'), 'c', 'k') WHEN word LIKE 'm%' THEN word || 'e' ELSE word END AS norm FROM w WHERE word <> ''),
v AS (SELECT surface, norm, count(*) AS n FROM p GROUP BY 1, 2),
b AS (SELECT surface, norm, CAST(sum(n) OVER (PARTITION BY surface) AS BIGINT) AS n FROM v QUALIFY row_number() OVER (PARTITION BY surface ORDER BY v.n DESC, norm DESC) = 1),
s AS (SELECT b.*, m, replace(surface, 'ſ', 's') AS f0 FROM b, range(0, 16) r(m)),
f1 AS (SELECT *, CASE WHEN m & 1 > 0 THEN replace(replace(f0, 'ey', 'ei'), 'Ey', 'Ei') ELSE f0 END AS f FROM s),
f2 AS (SELECT * REPLACE (CASE WHEN m & 2 > 0 THEN replace(replace(f, 'th', 't'), 'Th', 'T') ELSE f END AS f) FROM f1),
f3 AS (SELECT * REPLACE (CASE WHEN m & 4 > 0 THEN replace(f, 'ff', 'f') ELSE f END AS f) FROM f2),
f4 AS (SELECT * REPLACE (CASE WHEN m & 8 > 0 THEN replace(replace(f, 'c', 'k'), 'C', 'K') ELSE f END AS f) FROM f3),
c AS (SELECT surface, norm, n, min(CAST(bit_count(m) AS INT) * 100 + m) FILTER (f = norm) % 100 AS m FROM f4 GROUP BY ALL),
d AS (SELECT surface, norm, n, CASE WHEN surface = 'the' THEN 'ruling' WHEN surface = norm THEN 'identity' WHEN m IS NULL THEN 'residual' WHEN m = 0 THEN 'long_s' WHEN m & 1 > 0 THEN 'ey_ei' WHEN m & 2 > 0 THEN 'th_t' WHEN m & 4 > 0 THEN 'ff_f' ELSE 'c_k' END AS class FROM c),
lexicon AS (SELECT *, CASE WHEN class = 'ruling' THEN 'THE' WHEN report IS NULL AND class NOT IN ('identity', 'residual') THEN norm END AS result FROM (SELECT *, CASE WHEN class = 'ruling' THEN NULL WHEN class = 'residual' THEN 'residual' WHEN class <> 'identity' AND contains(norm, 'ss') THEN 'ss_audit'
WHEN regexp_matches(norm, 'ſ|ey|Ey') THEN 'cab_unnormalized' END AS report FROM d))"""


def _entries(t):
    """Words of all documents as if printed with long s and old spellings, with forms that differ between documents, and one ruling."""
    words = t.documents.select("doc_id", F.explode(F.split("text", "[^a-zA-Z]+")).alias("word")).filter("word <> ''")
    word, printed = F.col("word"), F.replace("word", F.lit("s"), F.lit("ſ"))
    plain = F.replace(word, F.lit("th"), F.lit("t"))
    norm = F.when(word.startswith("e"), printed).when(F.col("doc_id") % 3 == 0, plain).when(F.col("doc_id") % 3 == 1, F.replace(plain, F.lit("c"), F.lit("k"))).when(word.startswith("m"), F.concat(word, F.lit("e"))).otherwise(word)
    return L.lexicon(words.select(printed.alias("surface"), norm.alias("norm")), t.spark.createDataFrame([("the", "THE")], "surface string, ruling string"))


@query(_PAIRS + " SELECT surface, norm, n, class, result, report FROM lexicon")
def spelling_lexicon(t):
    return _entries(t)


@query(_PAIRS + r""", x AS (SELECT conv_id, turn, role, replace(text, 's', 'ſ') AS text FROM conversations),
r AS (SELECT *, generate_subscripts(runs, 1) AS k, unnest(runs) AS run FROM (SELECT conv_id, turn, role, text, regexp_extract_all(text, '\p{L}+|[^\p{L}]+') AS runs FROM (SELECT DISTINCT * FROM x)))
SELECT text, string_agg(coalesce(result, run), '' ORDER BY k) AS modern, contains(string_agg(coalesce(result, run), '' ORDER BY k), 'ſ') AS keeps_long_s
FROM (SELECT DISTINCT text, k, run FROM r) LEFT JOIN lexicon ON surface = run GROUP BY text""")
def modernised_texts(t):
    """Each distinct text of the conversations."""
    texts = t.conversations.select(F.replace("text", F.lit("s"), F.lit("ſ")).alias("text")).distinct()
    keyed = texts.select(F.col("text").alias("key"), "text")
    return L.modernised(keyed, "key", "text", _entries(t)).withColumnRenamed("key", "text")


@query("""
WITH RECURSIVE src AS (SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 5 = 0 THEN 10 WHEN p_size % 5 <> 1 THEN p_size END AS year, CASE WHEN p_partkey % 4 IN (2, 3) THEN p_partkey - 1 END AS up, CASE WHEN p_partkey % 8 = 4 THEN p_partkey - 4 WHEN p_partkey % 16 = 8 THEN p_partkey - 8 END AS parent FROM part WHERE p_size <> 13),
r AS (SELECT id, id AS root, 0 AS d FROM src UNION ALL SELECT r.id, s.up, d + 1 FROM r JOIN src s ON s.id = r.root WHERE s.up IN (SELECT id FROM src)), roots AS (SELECT id, arg_max(root, d) AS root FROM r GROUP BY 1),
u AS (SELECT id, id AS top, 0 AS d FROM src UNION ALL SELECT u.id, s.parent, d + 1 FROM u JOIN src s ON s.id = u.top WHERE s.parent IN (SELECT id FROM src)), tops AS (SELECT id, arg_max(top, d) AS top FROM u GROUP BY 1),
b AS (SELECT l_orderkey AS book, l_partkey AS source, CASE l_linestatus WHEN 'O' THEN 'en' ELSE 'de' END AS lang, 'b' || l_orderkey AS slug FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 20),
i AS (SELECT source, lang, slug, '' AS node FROM b UNION ALL SELECT l_partkey, lang, slug, 'n' || l_suppkey FROM lineitem JOIN b ON book = l_orderkey WHERE l_linenumber = 2 AND l_quantity > 20),
v AS (SELECT i.*, root, title, (source <> root, lang, slug, node, source) AS o FROM i JOIN roots ON id = source JOIN src USING (id)),
w AS (SELECT root AS work, string_agg(concat_ws('/', lang, slug, node, source), ' ' ORDER BY o) AS versions, count(*) AS n, arg_min(title, o) FILTER (lang = 'en') AS english FROM v GROUP BY 1),
p AS (SELECT l_partkey AS work, l_returnflag AS role, list(s_name ORDER BY l_orderkey, l_suppkey) AS names, arg_min(l_suppkey, (l_orderkey, l_suppkey)) AS person FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 3 AND l_quantity > 45 GROUP BY 1, 2),
k AS (SELECT w.*, year, parent, title AS own, coalesce(english, title) AS title, coalesce(a.person, e.person) AS person, CASE WHEN a.person IS NOT NULL THEN array_to_string(a.names[2:], ',') ELSE '' END AS co, CASE WHEN a.person IS NULL THEN array_to_string(e.names, ',') END AS eds
FROM w JOIN src ON src.id = w.work LEFT JOIN p a ON a.work = w.work AND a.role = 'A' LEFT JOIN p e ON e.work = w.work AND e.role = 'R'),
h AS (SELECT work AS top, CASE WHEN person IS NULL THEN 'self' ELSE 'author' END AS kind, coalesce(person, work) AS key, coalesce(s_name, own) AS label FROM k LEFT JOIN supplier ON s_suppkey = person WHERE parent IS NULL),
m AS (SELECT kind, key, label, k.* FROM h JOIN k ON k.work = top WHERE kind = 'author' OR n > 1 UNION ALL SELECT kind, key, label, k.* FROM k JOIN tops ON id = work JOIN h USING (top) WHERE parent IS NOT NULL)
SELECT kind, key, label, row_number() OVER (PARTITION BY kind, key ORDER BY year NULLS LAST, title, work) AS place, work, title, year, co AS co_authors, eds AS editors, versions FROM m
UNION ALL SELECT kind, key, label, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM h WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.kind = h.kind AND m.key = h.key)""")
def library_catalogue(t):
    """Parts as sources, of which some translate others and some lie in compilations; lines as books, nodes and persons; a row for each work of a group, and one for a group that lists none."""
    k, size = F.col("p_partkey"), F.col("p_size")
    sources = t.part.filter("p_size <> 13").select(
        k.alias("source"),
        F.col("p_name").alias("title"),
        F.when(size % 5 != 1, size).alias("published"),
        F.when(size % 5 == 0, 10).alias("original"),
        F.when((k % 4).isin(2, 3), k - 1).alias("translation_of"),
        F.when(k % 8 == 4, k - 4).when(k % 16 == 8, k - 8).alias("parent"),
    )
    lines = t.lineitem.withColumn("book", F.col("l_orderkey")).withColumn("source", F.col("l_partkey"))
    books = lines.filter("l_linenumber = 1 and l_quantity > 20").select("book", "source", F.when(F.col("l_linestatus") == "O", "en").otherwise("de").alias("language"), F.format_string("b%d", "book").alias("slug"))
    anchors = lines.filter("l_linenumber = 2 and l_quantity > 20").select("book", "source", F.format_string("n%d", "l_suppkey").alias("node"))
    role = F.when(F.col("l_returnflag") == "A", "author").when(F.col("l_returnflag") == "R", "editor").otherwise("translator")
    persons = lines.filter("l_linenumber = 3 and l_quantity > 45").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    persons = persons.select("source", role.alias("role"), F.col("book").alias("position"), F.col("l_suppkey").alias("person"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("sort_name"))
    groups = C.library(sources, C.versions(books, anchors), persons)
    each = groups.select("kind", "key", "label", F.posexplode_outer("works").alias("p", "w"))
    shown = F.array_join(F.transform("w.versions", lambda v: F.concat_ws("/", v["language"], v["slug"], F.coalesce(v["node"], F.lit("")), v["source"].cast("string"))), " ")
    return each.select("kind", "key", "label", (F.col("p") + 1).cast("long").alias("place"), "w.work", "w.title", "w.year", F.array_join("w.co_authors", ",").alias("co_authors"), F.array_join("w.editors", ",").alias("editors"), shown.alias("versions"))
