"""Curated editions: blocks, forced sentences, phrases and slices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sentences as S
from ..operators import corpora as C
from ..operators import hierarchy as T
from ..operators import nodepages as N
from ..operators import passages as G
from ..operators import phrases as P
from ..operators import ranges as A
from ..operators import resources as R
from ..operators.lineage import dealt
from ..sources import blocks, epub, ocr, prose, sinks, tei
from .tables import query


def _bodies(t):
    """Documents as markdown: each line that is not blank a block, in turn a heading, a note, a run, a rule, a figure and plain."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")

    def block(x, i):
        kind = i % 6
        note = F.concat(F.lit("[^"), i.cast("string"), F.lit("]: "), x)
        figure = F.concat(F.lit("<figure><figcaption>"), x, F.lit("</figcaption></figure>"))
        return F.when(kind == 0, F.concat(F.lit("## "), x)).when(kind == 1, note).when(kind == 2, F.concat(F.lit("+ "), x)).when(kind == 3, "---").when(kind == 4, figure).otherwise(x)

    return t.documents.select("doc_id", "source", "lang", F.array_join(F.transform(lines, block), "\n\n").alias("body"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS x, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) - 1 AS i FROM documents)
SELECT doc_id, i AS position, CASE i % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'footnote' WHEN 3 THEN 'separator' WHEN 4 THEN 'figure' ELSE 'paragraph' END AS kind,
  CASE i % 6 WHEN 1 THEN i::VARCHAR WHEN 3 THEN '---' END AS marker,
  CASE i % 6 WHEN 0 THEN rtrim(x) WHEN 1 THEN trim(x) WHEN 2 THEN '␞' || rtrim(x) WHEN 3 THEN '' WHEN 4 THEN '<figure><figcaption>' || x || '</figcaption></figure>' ELSE trim(x) END AS text FROM l""")
def prose_blocks(t):
    return blocks.blocks(_bodies(t).select("doc_id", "body")).select("doc_id", "position", "kind", "marker", "text")


@query()
def prose_sentences(t):
    """Each document a file of its source's book: numbered sentences, runs, notes, figures."""
    files = _bodies(t).select(F.col("source").alias("book"), F.col("doc_id").alias("file"), F.col("lang").alias("language"), "body")
    return prose.sentences(files).select("book", "file", "block", "kind", "block_number", "position", "sentence_number", "segment", "text")


@query(r"""
WITH s AS (SELECT item_id, string_split(replace(text, ',', '|||'), '|||') AS parts, text FROM benchmark),
p AS (SELECT item_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM s)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY k) - 1 AS position, trim(part, ' ' || chr(10) || chr(9) || chr(13)) AS text FROM p WHERE trim(part, ' ' || chr(10) || chr(9) || chr(13)) <> ''""")
def forced_sentences(t):
    """Boundaries imposed from outside, at each comma, and none by punctuation."""
    marked = t.benchmark.select("item_id", F.replace("text", F.lit(","), F.lit("|||")).alias("text")).withColumn("cut", S.forced(F.col("text")))
    pairs = marked.select("item_id", F.posexplode(S.paired(F.col("cut.text"), F.col("cut.text"), F.col("cut.positions"))).alias("position", "p"))
    return pairs.select("item_id", "position", "p.text")


@query(r"""
WITH i AS (SELECT string_split(regexp_replace(trim(text), '\s+', ' ', 'g'), ' ') AS w FROM benchmark),
k AS (SELECT DISTINCT unnest([array_to_string(w[1:1], ' '), array_to_string(w[1:2], ' '), array_to_string(w[2:4], ' '), array_to_string(w[3:5], ' ')]) AS phrase FROM i WHERE len(w) >= 5),
d AS (SELECT doc_id, string_split(regexp_replace(trim(text), '\s+', ' ', 'g'), ' ') AS w FROM documents),
r AS (SELECT doc_id, n, unnest(generate_series(0, len(w) - n)) AS place, w FROM d, (SELECT unnest([1, 2, 3]) AS n)),
c AS (SELECT doc_id, place, max(n) AS size, arg_max(phrase, n) AS phrase FROM (SELECT doc_id, n, place, array_to_string(w[place + 1 : place + n], ' ') AS phrase FROM r) JOIN k USING (phrase) GROUP BY ALL),
b AS (SELECT doc_id, list(struct_pack(place := place, size := size, phrase := phrase) ORDER BY place) AS m FROM c GROUP BY doc_id),
g AS (SELECT doc_id, list_reduce(list_prepend([struct_pack(place := -1, size := 0, phrase := '')], list_transform(m, lambda x: [x])), lambda a, x: CASE WHEN x[1].place >= a[len(a)].place + a[len(a)].size THEN list_concat(a, x) ELSE a END) AS m FROM b)
SELECT doc_id, p.place AS place, p.size AS size, p.phrase AS phrase FROM (SELECT doc_id, unnest(m[2:]) AS p FROM g)""")
def dictionary_phrases(t):
    """The longest phrases of a dictionary of the benchmark's openings in all documents."""

    def words(c):
        return F.split(F.regexp_replace(F.trim(c), r"[ \t\n\x0B\f\r]+", " "), " ")

    w = words(F.col("text"))
    openings = F.array(*[F.array_join(F.slice(w, a, n), " ") for a, n in ((1, 1), (1, 2), (2, 3), (3, 3))])
    known = t.benchmark.filter(F.size(w) >= 5).select(F.explode(openings).alias("phrase"))
    return P.phrase_matches(t.documents.select("doc_id", w.alias("words")), "doc_id", "words", known, "phrase")


@query(r"""
WITH RECURSIVE w AS (
  SELECT DISTINCT s, replace(replace(replace(s, 'th', 't'), 'ei', 'ey'), 'ß', 'ss') AS t FROM (SELECT unnest(regexp_extract_all(text, '[a-zäöüß]{7,20}')) AS s FROM benchmark)),
p AS (
  SELECT s, t, length(s) AS i, length(t) AS j FROM w
  UNION ALL SELECT s, t, CASE WHEN sub OR gone THEN i - 1 ELSE i END, CASE WHEN sub OR NOT gone THEN j - 1 ELSE j END
  FROM (SELECT *, i > 0 AND j > 0 AND here = levenshtein(s[1 : i - 1], t[1 : j - 1]) + CASE WHEN s[i] = t[j] THEN 0 ELSE 1 END AS sub, i > 0 AND here = levenshtein(s[1 : i - 1], t[1:j]) + 1 AS gone
        FROM (SELECT *, levenshtein(s[1:i], t[1:j]) AS here FROM p WHERE i > 0 OR j > 0))),
m AS (SELECT s, t, min(j) FILTER (i = 3) AS a, min(j) FILTER (i = length(s) // 2 + 2) AS b FROM p GROUP BY s, t)
SELECT s AS word, t[1:a] AS first, t[a + 1 : b] AS second, t[b + 1 :] AS third FROM m""")
def sliced_spellings(t):
    """Respelled words cut where their old form is cut: after three letters and behind the middle."""
    old = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("([a-zäöüß]{7,20})"), F.lit(1))).alias("word")).distinct()
    new = F.replace(F.replace(F.replace("word", F.lit("th"), F.lit("t")), F.lit("ei"), F.lit("ey")), F.lit("ß"), F.lit("ss"))
    cuts = F.array(F.lit(3), (F.floor(F.char_length("word") / 2) + 2).cast("int"))
    parts = old.withColumn("target", new).withColumn("p", P.slices(F.col("word"), F.col("target"), cuts))
    return parts.select("word", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("first", "second", "third"))])


@query(r"""
WITH c AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents),
x AS (SELECT doc_id, text, w[2] || ' ' || w[3] AS search FROM c WHERE len(w) >= 3)
SELECT c.doc_id, CASE WHEN once THEN replace(c.text, search, '[' || search || ']') ELSE c.text END AS text, CASE WHEN once OR search IS NULL THEN 0 ELSE 1 END AS n_refused
FROM c LEFT JOIN (SELECT *, search <> '' AND length(text) - length(replace(text, search, '')) = length(search) AS once FROM x) x ON c.doc_id = x.doc_id""")
def corrections_once(t):
    """A correction for each document, made only where its words stand once."""
    w = F.split("text", " ")
    search = F.concat_ws(" ", F.get(w, F.lit(1)), F.get(w, F.lit(2)))
    ops = t.documents.filter(F.size(w) >= 3).select("doc_id", F.lit(1).alias("number"), search.alias("search"), F.concat(F.lit("["), search, F.lit("]")).alias("replace"))
    return P.corrected(t.documents.select("doc_id", "text"), ops, "doc_id", "text").select("doc_id", "text", F.size("refused").alias("n_refused"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
u AS (SELECT doc_id, p, unnest(string_split(line, ', ')) AS part, generate_subscripts(string_split(line, ', '), 1) AS k, len(string_split(line, ', ')) AS n FROM l),
a AS (SELECT doc_id, p, k, length(part) + CASE WHEN k < n THEN 2 ELSE 0 END AS size FROM u),
o AS (SELECT doc_id, p, k, size, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY p, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM a),
par AS (SELECT doc_id, p, min(start) AS start, max(start + size) AS stop FROM o GROUP BY ALL),
cuts AS (SELECT doc_id, start, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) AS label FROM o WHERE k > 1),
pages AS (SELECT doc_id, label, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY label), (SELECT max(stop) FROM par WHERE par.doc_id = cuts.doc_id)) AS stop FROM cuts)
SELECT g.doc_id, g.label, g.start::BIGINT AS start, g.stop::BIGINT AS stop, count(*) AS n_paragraphs FROM pages g JOIN par USING (doc_id) WHERE g.start < g.stop AND par.start < par.stop AND g.start < par.stop AND par.start < g.stop GROUP BY ALL""")
def milestone_pages(t):
    """Documents as XML, a page beginning behind each comma: the pages' ranges of text and how many paragraphs each touches."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit("<text><p>"), F.replace(F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit(", "), F.lit(", <pb/>")), F.lit("</p></text>"))
    at = tei.placed(tei.events(t.documents.select(F.col("doc_id").alias("file"), xml.alias("xml"))))
    pages = tei.milestone_ranges(at, "pb").withColumn("label", F.row_number().over(Window.partitionBy("file").orderBy("n")))
    paragraphs = tei.element_ranges(at, "p").select("file", F.col("start").alias("p_start"), F.col("stop").alias("p_stop"))
    closed = [df.filter(F.col(a) < F.col(b)).withColumn(b, F.col(b) - 1) for df, a, b in ((pages, "start", "stop"), (paragraphs, "p_start", "p_stop"))]
    touched = A.overlap_join(*closed, ["file"], ("start", "stop"), ("p_start", "p_stop"), 512)
    return touched.groupBy(F.col("file").alias("doc_id"), "label", "start", (F.col("stop") + 1).alias("stop")).agg(F.count("*").alias("n_paragraphs"))


_LINES = "FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)"


def _responses(t):
    """Documents as recognised pages: each line a row 30 pixels below the last, later ones further right; indices are numbers or strings."""
    lines = F.split("text", "\n")
    ends = S._running(F.transform(lines, lambda x: F.char_length(x) + 1))
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))

    def line(a, b, i):
        y = (i * 30).cast("double") / 2000
        x = F.when(i % 7 == 3, 0.2).otherwise(0.1)
        corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
        segment = F.struct(a.cast("string").alias("startIndex"), b.cast("string").alias("endIndex"))
        box = F.struct(F.array(corner(0, 0), corner(0.25, 0.01)).alias("normalizedVertices"))
        return F.struct(F.struct(F.struct(F.array(segment).alias("textSegments")).alias("textAnchor"), box.alias("boundingPoly")).alias("layout"))

    pairs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    page = F.struct(F.struct(F.lit(1000.0).alias("width"), F.lit(2000.0).alias("height")).alias("dimension"), F.transform(pairs, lambda p, i: line(p["a"], p["b"], i)).alias("lines"))
    return t.documents.select(F.col("doc_id").alias("page"), F.to_json(F.struct("text", F.array(page).alias("pages"))).alias("response"))


@query(f"""
SELECT doc_id AS page, n, line AS text, CASE WHEN n % 7 = 3 THEN 200 ELSE 100 END AS x, n * 30 AS y {_LINES} WHERE trim(line) <> ''""")
def ocr_response_lines(t):
    found = ocr.lines(_responses(t))
    return found.select("page", "n", "text", F.round("x").cast("int").alias("x"), F.round("y").cast("int").alias("y"))


@query(f"""
WITH l AS (SELECT *, CASE WHEN n % 7 = 3 THEN 200 ELSE 100 END AS x, n * 30 AS y {_LINES} WHERE trim(line) <> '' AND (n * 30 >= 220 OR doc_id <= 0)),
s AS (SELECT *, y - lag(y) OVER (PARTITION BY doc_id ORDER BY y) AS gap FROM l),
m AS (SELECT doc_id, median(gap) FILTER (gap > 0) AS mid, median(x) AS edge FROM s GROUP BY doc_id),
g AS (SELECT s.*, sum(CASE WHEN mid IS NOT NULL AND gap IS NOT NULL AND (gap > 1.5 * mid OR x > edge + 30) THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id ORDER BY y) AS element FROM s JOIN m USING (doc_id))
SELECT doc_id AS page, element::BIGINT AS element, string_agg(line, chr(10) ORDER BY y) AS text, count(*)::INT AS n_lines FROM g GROUP BY doc_id, element""")
def ocr_page_elements(t):
    """The paragraphs of recognised pages, by spacing and indentation; every page in body and header alone."""
    found = ocr.zoned(ocr.lines(_responses(t)), height=1e9)
    return ocr.elements(found).select("page", "element", "text", F.size("lines").alias("n_lines"))


@query(r"""
SELECT doc_id, regexp_replace(replace(replace(text, ', ', ' " '), '. ', '." '), '(„[^"]*")|"', '\1', 'g') AS text FROM (SELECT doc_id, replace(text, ' die ', ' „die ') AS text FROM documents)""")
def ocr_cleaned(t):
    marked = F.replace(F.replace(F.replace("text", F.lit(" die "), F.lit(" „die ")), F.lit(", "), F.lit(' " ')), F.lit(". "), F.lit('." '))
    return t.documents.select("doc_id", ocr.cleaned(marked).alias("text"))


@query(r"""
WITH l AS (SELECT doc_id, n, trim(line) || CASE WHEN n % 3 = 0 THEN '-' ELSE '' END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents))
SELECT doc_id, CASE WHEN ends_with(whole, '- ') THEN left(whole, length(whole) - 1) ELSE rtrim(whole) END AS text
FROM (SELECT doc_id, replace(string_agg(line, ' ' ORDER BY n) FILTER (line <> '') || ' ', '- ', chr(1)) AS w FROM l GROUP BY doc_id), LATERAL (SELECT CASE WHEN ends_with(w, chr(1)) THEN replace(left(w, length(w) - 1), chr(1), '') || '- ' ELSE replace(w, chr(1), '') END AS whole)""")
def ocr_stitched(t):
    """Lines of a page as one text; every third is torn by a hyphen."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(S.trimmed(x), F.when(i % 3 == 0, "-").otherwise("")))
    return t.documents.select("doc_id", ocr.stitched(lines).alias("text"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) - 1 AS n FROM documents),
k AS (SELECT doc_id, n, trim(line) AS line, CASE WHEN n % 5 = 2 THEN 'head' WHEN n % 11 = 10 THEN 'latch' ELSE 'p' END AS kind FROM l),
s AS (SELECT *, max(CASE WHEN kind = 'head' THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM k),
f AS (SELECT *, coalesce(bool_or(kind = 'latch') OVER (PARTITION BY doc_id, section ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS noted FROM s WHERE section IS NOT NULL)
SELECT doc_id, 's' || section AS id, row_number() OVER (PARTITION BY doc_id, section ORDER BY n) - 1 AS position, CASE WHEN kind = 'head' THEN 'heading' WHEN noted THEN 'footnote' ELSE 'paragraph' END AS kind, line AS text
FROM f WHERE kind <> 'latch' AND NOT (noted AND kind = 'head')""")
def epub_sections(t):
    """Documents as members of a book, cut into sections where their headings stand; notes from their heading to the section's end."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")

    def element(x, i):
        safe = F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        head = F.concat(F.lit('<h2 id="s'), i.cast("string"), F.lit('">'), safe, F.lit("</h2>"))
        return F.when(i % 5 == 2, head).when(i % 11 == 10, '<p class="fn">Fußnoten</p>').otherwise(F.concat(F.lit("<p>"), safe, F.lit("</p>")))

    xml = F.concat(F.lit("<html><body>"), F.array_join(F.transform(lines, element), ""), F.lit("</body></html>"))
    elements = epub.body_elements(tei.events(t.documents.select(F.col("doc_id").alias("file"), xml.alias("xml")))).withColumnRenamed("file", "doc_id")
    heads = t.documents.select("doc_id", F.explode(F.filter(F.sequence(F.lit(0), F.size(lines)), lambda i: (i % 5 == 2) & (i < F.size(lines)))).alias("play_order"))
    points = heads.withColumn("id", F.concat(F.lit("s"), F.col("play_order").cast("string"))).withColumn("fragment", F.col("id"))
    return epub.sections(elements, points, ["doc_id"]).select("doc_id", "id", "position", "kind", "text")


@query(r"""
WITH b AS (SELECT source AS book, DATE '2024-01-01' + max(n_chars)::INT AS changed FROM documents GROUP BY source),
r AS (
  SELECT 'books/' || book || '.xml' AS file, -3 AS k, '<?xml version="1.0" encoding="UTF-8"?>' AS value FROM b
  UNION ALL SELECT 'books/' || book || '.xml', -2, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' FROM b
  UNION ALL SELECT 'books/' || book || '.xml', -1, '  <url><loc>https://example.org/books/' || book || '</loc><lastmod>' || changed || '</lastmod></url>' FROM b
  UNION ALL SELECT 'books/' || source || '.xml', doc_id, '  <url><loc>https://example.org/books/' || source || '/d&lt;' || doc_id || '</loc><lastmod>' || (DATE '2024-01-01' + n_chars::INT) || '</lastmod></url>' FROM documents
  UNION ALL SELECT 'books/' || book || '.xml', 1000000000000, '</urlset>' FROM b)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY k) - 1 AS n, value FROM r""")
def sitemap_files(t):
    """A sitemap a source with its documents, escaped and framed."""
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int"))
    books = t.documents.groupBy(F.col("source").alias("book")).agg(day(F.max("n_chars")).alias("changed"))
    nodes = t.documents.select(F.col("source").alias("book"), F.concat(F.lit("d<"), F.col("doc_id").cast("string")).alias("node"), F.col("doc_id").alias("sort_order"), day(F.col("n_chars")).alias("changed"))
    return sinks.book_sitemaps(books, nodes, "https://example.org")


@query(r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations), r AS (
  SELECT conv_id, 0 AS part, k, unnest(['---', 'position: ' || conv_id, 'label: "c' || conv_id || '"', 'depth: 1', 'page: ' || conv_id % 9, '---', '', '# c' || conv_id]) AS value, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8], 1) AS i FROM (SELECT DISTINCT conv_id, 0 AS k FROM c)
  UNION ALL SELECT conv_id, 1, turn, unnest(['', CASE WHEN role = 'user' THEN '## ' ELSE '' END || CASE WHEN turn // 2 IS DISTINCT FROM before THEN '{{{ ' || turn // 2 || ' }}} ' ELSE '' END || text[1:length(text) // 2] || '{{ ' || turn || ' }} ' || text[length(text) // 2 + 1:]]), generate_subscripts([1, 2], 1)
    FROM (SELECT *, lag(turn // 2) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM c WHERE role <> 'system' AND length(text) > 1)
  UNION ALL SELECT conv_id, 2, turn, unnest(CASE WHEN first THEN ['', '[^' || turn || ']: ' || text] ELSE ['[^' || turn || ']: ' || text] END), generate_subscripts(CASE WHEN first THEN [1, 2] ELSE [1] END, 1) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS first FROM c WHERE role = 'system'))
SELECT lpad(conv_id::VARCHAR, greatest(3, length(conv_id::VARCHAR))::INT, '0') || '_c' || conv_id || '.md' AS file, row_number() OVER (PARTITION BY conv_id ORDER BY part, k, i) - 1 AS n, value FROM r""")
def markdown_lines(t):
    """Conversations as markdown files: turns are blocks with page marks, a system's turns notes."""
    c = t.conversations
    nodes = c.select(F.col("conv_id").alias("node")).distinct()
    nodes = nodes.select("node", F.col("node").alias("position"), F.concat(F.lit("c"), F.col("node").cast("string")).alias("slug"), F.concat(F.lit("c"), F.col("node").cast("string")).alias("label"), F.lit(1).alias("depth"), (F.col("node") % 9).alias("page"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    anchors = F.array(F.struct(F.col("turn").cast("string").alias("ref"), half.alias("char_offset")))
    blocks = c.filter("role <> 'system' AND length(text) > 1").select(F.col("conv_id").alias("node"), F.col("turn").alias("block"), F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("kind"), "text", F.floor(F.col("turn") / 2).alias("page"), anchors.alias("anchors"))
    notes = c.filter("role = 'system'").select(F.col("conv_id").alias("node"), F.col("turn").alias("note"), F.col("turn").cast("string").alias("marker"), "text")
    return sinks.markdown_lines(nodes, blocks, notes)


@query(r"""
SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n,
  repeat('  ', (doc_id % 3)::INT) || '- ' || CASE WHEN doc_id % 2 = 0 THEN '[' || lang || '](' || lpad(doc_id::VARCHAR, greatest(3, length(doc_id::VARCHAR))::INT, '0') || '_' || lang || '.md)' ELSE lang END || ' — p. ' || n_chars AS value FROM documents""")
def toc_lines(t):
    entries = t.documents.select(F.col("source").alias("book"), F.col("doc_id").alias("position"), F.col("lang").alias("slug"), F.col("lang").alias("label"), (F.col("doc_id") % 3 + 1).cast("int").alias("depth"), F.col("n_chars").alias("page"), (F.col("doc_id") % 2 == 0).alias("has_file"))
    return sinks.toc_lines(entries)


@query(r"""
WITH RECURSIVE e AS (SELECT c_custkey AS node, c_nationkey AS rank, CASE WHEN c_custkey // 4 IN (SELECT c_custkey FROM customer) AND c_custkey > 0 THEN c_custkey // 4 END AS parent FROM customer),
w AS (
  SELECT node, node AS root, 1 AS level, [struct_pack(o := rank, n := node)] AS path FROM e WHERE parent IS NULL
  UNION ALL SELECT e.node, root, level + 1, list_append(path, struct_pack(o := rank, n := e.node)) FROM e JOIN w ON e.parent = w.node)
SELECT w.node, root, level, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS place, coalesce((SELECT string_agg(k.node, ',' ORDER BY rank, k.node) FROM e k WHERE k.parent = w.node), '') AS children FROM w""")
def toc_outline(t):
    """Trees of customers, four children each, laid out in reading order."""
    rows = t.customer.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("rank"), F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 4)).alias("parent"))
    return T.outline(rows, "node", "parent", "rank").select("node", "root", "level", "place", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"))


@query(r"""
WITH s AS (SELECT o_orderkey % 10 AS book, 'body' AS kind, o_orderkey // 10 AS number, (o_orderkey % 10) // 5 AS work, CASE WHEN (o_orderkey // 10) % 7 <> 0 THEN (o_orderkey // 10) // 2 + (o_orderkey % 10) % 3 END AS ordinal FROM orders),
r AS (SELECT l_orderkey AS resource, l_partkey % 10 AS book, 'body' AS kind, l_partkey // 10 AS first, CASE WHEN l_quantity > 25 THEN l_partkey // 10 + l_suppkey % 4 END AS last, CASE WHEN l_linestatus = 'O' THEN 'approved' ELSE 'pending' END AS status, l_suppkey AS submitted_by,
  l_quantity > 40 AS featured, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey END AS year, CASE WHEN l_partkey % 2 = 0 THEN l_quantity END AS page FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag, l_linestatus) = 1) WHERE l_returnflag <> 'R'),
q AS (SELECT s_suppkey AS request, s_suppkey % 10 AS book, 'body' AS kind, s_suppkey // 2 AS start, s_suppkey // 2 + 6 AS stop, s_suppkey AS viewer FROM supplier),
own AS (SELECT request, resource, first, coalesce(last, first) AS last, NULL::VARCHAR AS origin FROM q JOIN r USING (book, kind) WHERE first <= stop AND coalesce(last, first) >= start AND (status = 'approved' OR (status = 'pending' AND submitted_by = viewer))),
t AS (SELECT request, q.book, q.kind, work, min(ordinal) AS low, max(ordinal) AS high FROM q JOIN s ON s.book = q.book AND s.kind = q.kind AND number BETWEEN start AND stop WHERE ordinal IS NOT NULL GROUP BY ALL),
p AS (
  SELECT t.request, r.resource, t.book, t.kind, t.work, a.ordinal AS f, CASE WHEN r.last IS NULL THEN a.ordinal ELSE coalesce(b.ordinal, a.ordinal) END AS l, r.book::VARCHAR AS origin
  FROM r JOIN s a ON a.book = r.book AND a.kind = r.kind AND a.number = r.first AND a.ordinal IS NOT NULL LEFT JOIN s b ON b.book = r.book AND b.kind = r.kind AND b.number = r.last
  JOIN t ON t.work = a.work AND t.kind = r.kind WHERE r.status = 'approved' AND r.book <> t.book),
pr AS (SELECT request, resource, (SELECT min(number) FROM s WHERE s.book = p.book AND s.kind = p.kind AND s.work = p.work AND s.ordinal BETWEEN f AND l) AS first,
  (SELECT max(number) FROM s WHERE s.book = p.book AND s.kind = p.kind AND s.work = p.work AND s.ordinal BETWEEN f AND l) AS last, origin
  FROM p JOIN t USING (request, work) WHERE f <= t.high AND l >= t.low)
SELECT request, resource, first, last, origin, row_number() OVER (PARTITION BY request ORDER BY featured DESC, year DESC NULLS LAST, page NULLS LAST, resource) - 1 AS place
FROM (SELECT * FROM own UNION ALL SELECT * FROM pr) JOIN (SELECT resource, featured, year, page FROM r) USING (resource)""")
def projected_resources(t):
    """Resources at requested places of ten editions of two works, their own and those of the other editions, in one order."""
    key = F.col("o_orderkey")
    number, book = F.floor(key / 10), key % 10
    ordinal = F.when(number % 7 != 0, F.floor(number / 2) + book % 3)
    sentences = t.orders.select(book.alias("book"), F.lit("body").alias("kind"), number.alias("number"), F.floor(book / 5).alias("work"), ordinal.alias("ordinal"))
    first = F.floor(F.col("l_partkey") / 10)
    rows = t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")).alias("m")).select("l_orderkey", "m.*")
    resources = rows.select(
        F.col("l_orderkey").alias("resource"), (F.col("l_partkey") % 10).alias("book"), F.lit("body").alias("kind"), first.alias("start"), F.when(F.col("l_quantity") > 25, first + F.col("l_suppkey") % 4).alias("stop"),
        F.when(F.col("l_linestatus") == "O", "approved").otherwise("pending").alias("status"), F.col("l_suppkey").alias("submitted_by"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("archived_at"),
    )
    about = rows.select(F.col("l_orderkey").alias("resource"), (F.col("l_quantity") > 40).alias("featured"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey")).alias("year"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity")).alias("page"))
    supplier = F.col("s_suppkey")
    start = F.floor(supplier / 2)
    requests = t.supplier.select(supplier.alias("request"), (supplier % 10).alias("book"), F.lit("body").alias("kind"), start.alias("start"), (start + 6).alias("stop"), supplier.alias("viewer"))
    return R.listed(requests, resources, sentences, about).select("request", "resource", "first", "last", "origin", "place")


@query(r"""
SELECT kind, id, title, snippet, created, row_number() OVER (PARTITION BY viewer ORDER BY created DESC, kind, id) - 1 AS place, viewer FROM (
  SELECT 'book' AS kind, o_custkey AS viewer, o_orderkey AS id, NULL AS title, o_orderpriority AS snippet, o_orderdate::TIMESTAMP AS created FROM orders
  UNION ALL SELECT 'article', user_id, event_id, event_type, NULL, ts FROM events WHERE event_type <> 'view')""")
def unified_quotations(t):
    """Two kinds of quotations of a viewer as one list, newest first."""
    books = t.orders.select(F.lit("book").alias("kind"), F.col("o_custkey").alias("viewer"), F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("title"), F.col("o_orderpriority").alias("snippet"), F.col("o_orderdate").cast("timestamp_ntz").alias("created"))
    articles = t.events.filter("event_type <> 'view'").select(F.lit("article").alias("kind"), F.col("user_id").alias("viewer"), F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("snippet"), F.col("ts").cast("timestamp_ntz").alias("created"))
    order = Window.partitionBy("viewer").orderBy(F.desc("created"), "kind", "id")
    return books.unionByName(articles).withColumn("place", F.row_number().over(order) - 1)


@query(r"""
WITH v AS (SELECT l_returnflag AS work, l_linestatus AS source_ref, l_partkey AS ref_value, min(l_orderkey * 100 + l_linenumber) AS f FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY ALL),
n AS (SELECT work, source_ref, ref_value, row_number() OVER (PARTITION BY work ORDER BY f, source_ref, ref_value) AS o FROM v),
k AS (SELECT DISTINCT l_returnflag AS work, l_linestatus AS source_ref, l_partkey AS ref_value, -1 AS o FROM lineitem WHERE l_partkey % 3 = 0)
SELECT work, source_ref, ref_value, coalesce(n.o, k.o) AS ordinal FROM k FULL JOIN n USING (work, source_ref, ref_value)""")
def canonical_minting(t):
    """Passages of a leading edition numbered anew beside known ones."""
    names = [F.col("l_returnflag").alias("work"), F.col("l_linestatus").alias("source_ref"), F.col("l_partkey").alias("ref_value")]
    verses = t.lineitem.filter("l_suppkey % 2 = 0").select(*names, (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("number"))
    known = t.lineitem.filter("l_partkey % 3 = 0").select(*names).distinct().withColumn("ordinal", F.lit(-1).cast("long"))
    return G.minted(known, verses)


@query(r"""
WITH p AS (SELECT l_returnflag AS work, l_linestatus AS source_ref, l_partkey AS ref_value, min(l_orderkey) AS ordinal FROM lineitem GROUP BY ALL),
a AS (SELECT p_partkey AS ref_value, CASE WHEN p_partkey % 10 = 3 THEN p_partkey + 1 END AS c FROM part WHERE p_partkey % 5 = 3),
s AS (SELECT l_orderkey * 100 + l_linenumber AS sentence, l_suppkey % 4 AS book, l_returnflag AS work, l_linestatus AS source_ref, l_partkey AS ref_value, CASE WHEN l_quantity > 20 THEN l_orderkey END AS old FROM lineitem),
r AS (SELECT s.*, a.ref_value IS NOT NULL AND book = 1 AS aligned, c FROM s LEFT JOIN a ON a.ref_value = s.ref_value AND book = 1),
f AS (SELECT sentence, old, p.ordinal FROM r LEFT JOIN p ON p.work = r.work AND p.source_ref = (CASE WHEN aligned AND c IS NULL THEN NULL ELSE r.source_ref END) AND p.ref_value = CASE WHEN aligned THEN c ELSE r.ref_value END)
SELECT sentence, ordinal FROM f WHERE old IS DISTINCT FROM ordinal""")
def canonical_stamps(t):
    """Sentences of four editions stamped with their passages, one edition by its table of alignments."""
    names = [F.col("l_returnflag").alias("work"), F.col("l_linestatus").alias("source_ref"), F.col("l_partkey").alias("ref_value")]
    passages = t.lineitem.groupBy(*names).agg(F.min("l_orderkey").alias("ordinal"))
    sentences = t.lineitem.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("sentence"), (F.col("l_suppkey") % 4).alias("book"), *names, F.when(F.col("l_quantity") > 20, F.col("l_orderkey")).alias("ordinal"))
    kept = F.col("p_partkey") % 10 == 3
    refs = t.lineitem.select(F.col("l_linestatus").alias("source_ref")).distinct()
    rows = t.part.filter("p_partkey % 5 = 3").select(F.lit(1).cast("long").alias("book"), F.col("p_partkey").alias("ref_value"), F.when(kept, F.col("p_partkey") + 1).alias("canonical_ref_value"))
    alignments = rows.crossJoin(F.broadcast(refs)).withColumn("canonical_source_ref", F.when(F.col("canonical_ref_value").isNotNull(), F.col("source_ref")))  # two line states
    return G.stamped(sentences, alignments, passages)


@query(r"""
WITH a AS (SELECT DISTINCT o_custkey AS article FROM orders WHERE o_orderstatus = 'F'),
d AS (SELECT o_custkey AS article, 'b' || o_orderkey % 12 AS slug, o_orderkey % 40 AS first, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey % 40 + o_custkey % 30 END AS last FROM orders),
b AS (SELECT n_nationkey AS book, 'b' || n_nationkey AS slug FROM nation WHERE n_nationkey < 10),
s AS (SELECT p_partkey % 10 AS book, (p_partkey // 10) % 60 AS number, min(p_partkey) AS sentence FROM part GROUP BY ALL),
f AS (SELECT DISTINCT article, d.book, s.sentence AS start, e.sentence AS stop FROM (SELECT * FROM d JOIN a USING (article) JOIN b USING (slug)) d JOIN s ON s.book = d.book AND s.number = d.first LEFT JOIN s e ON e.book = d.book AND e.number = d.last WHERE d.last IS NULL OR e.sentence IS NOT NULL)
SELECT article, book, 'body' AS kind, start, stop FROM f UNION ALL SELECT c_custkey, c_nationkey, 'body', c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT article FROM a)""")
def passage_references_resynced(t):
    """References of saved articles taken from their directives anew, those of others kept."""
    articles = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("article"))
    first = F.col("o_orderkey") % 40
    directives = t.orders.select(F.col("o_custkey").alias("article"), F.concat(F.lit("b"), (F.col("o_orderkey") % 12).cast("string")).alias("slug"), F.lit("body").alias("kind"), first.alias("first"), F.when(F.col("o_orderkey") % 2 == 1, first + F.col("o_custkey") % 30).alias("last"))
    books = t.nation.filter("n_nationkey < 10").select(F.col("n_nationkey").cast("long").alias("book"), F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("slug"))
    sentences = t.part.groupBy((F.col("p_partkey") % 10).alias("book"), F.lit("body").alias("kind"), (F.floor(F.col("p_partkey") / 10) % 60).alias("number")).agg(F.min("p_partkey").alias("sentence"))
    old = t.customer.select(F.col("c_custkey").alias("article"), F.col("c_nationkey").cast("long").alias("book"), F.lit("body").alias("kind"), F.col("c_custkey").alias("start"), F.lit(None).cast("long").alias("stop"))
    return G.resynced(old, articles, directives, books, sentences)


_NODE = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS b FROM documents),
u AS (SELECT doc_id, b, unnest(string_split(line, ', ')) AS text, generate_subscripts(string_split(line, ', '), 1) - 1 AS p FROM l),
s AS (SELECT *, ascii(text) % 5 AS class, row_number() OVER (PARTITION BY doc_id ORDER BY b, p) AS number FROM u),
h AS (SELECT doc_id, b, p, class, number, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS k FROM s WHERE class IN (0, 1)),
g AS (SELECT doc_id, b, p, class, [{'number': number, 'sentences': list({'position': k, 'text': word, 'original_text': NULL::VARCHAR} ORDER BY k)}] AS notes FROM h GROUP BY doc_id, b, p, class, number),
"""


def _held(t):
    """Documents as nodes: lines are blocks, their clauses sentences; a clause's first letter says whether it has a footnote, a margin note or a page mark."""
    docs = dealt(t.documents.select(F.col("doc_id").alias("node"), "text"), "node", finer=16)
    lines = docs.select("node", F.posexplode(F.split("text", "\n")).alias("position", "line")).withColumn("block", F.concat_ws(":", "node", "position"))
    parts = lines.select("node", "block", F.col("position").alias("b"), F.posexplode(F.split("line", ", ")).alias("position", "text"))
    each = parts.select(
        "node", "block", F.concat_ws(":", "block", "position").alias("sentence"), "position", "text", F.reverse("text").alias("original_text"), (F.ascii("text") % 5).alias("class"),
        F.row_number().over(Window.partitionBy("node").orderBy("b", "position")).cast("long").alias("number"),
    )

    def notes(kind):
        mine = each.filter(F.col("class") == kind).select("node", "sentence", F.col("sentence").alias("note"), "number", "text")
        bodies = mine.select("node", "note", F.posexplode(F.split("text", " ")).alias("position", "text")).withColumn("original_text", F.col("text"))
        return mine.drop("text"), bodies

    blocks = lines.select("node", "block", "position", F.when(F.col("position") % 4 == 1, F.col("position")).alias("figure_number"))
    markers = each.filter("class = 2").select("node", "sentence", F.col("number").alias("sort_order"), F.lit("aa").alias("system"))
    return N.contents(blocks, each.drop("class", "number"), markers, {"footnotes": notes(0), "margin_notes": notes(1)}, within="node")


@query(_NODE + """
m AS (SELECT s.doc_id, s.b, list({'position': s.p, 'sentence': s.doc_id || ':' || s.b || ':' || s.p, 'text': s.text, 'original_text': NULL::VARCHAR, 'markers': CASE WHEN s.class = 2 THEN [{'sort_order': number, 'system': 'aa'}] ELSE [] END,
  'footnotes': CASE WHEN s.class = 0 THEN g.notes ELSE [] END, 'margin_notes': CASE WHEN s.class = 1 THEN g.notes ELSE [] END, 'figure_number': CASE WHEN s.b % 4 = 1 THEN s.b END} ORDER BY s.p) AS sentences
  FROM s LEFT JOIN g ON g.doc_id = s.doc_id AND g.b = s.b AND g.p = s.p GROUP BY ALL)
SELECT doc_id AS node, md5(CAST(to_json(list({'position': b, 'block': doc_id || ':' || b, 'figure_number': CASE WHEN b % 4 = 1 THEN b END, 'sentences': sentences} ORDER BY b)) AS VARCHAR)) AS page FROM m GROUP BY doc_id""")
def node_contents(t):
    """The digest of each document's nested content as JSON: blocks, sentences, marks, footnotes and margin notes."""
    note = "transform({0}, n -> named_struct('number', n.number, 'sentences', n.sentences))"
    bare = "transform(sentences, s -> named_struct('position', s.position, 'sentence', s.sentence, 'text', s.text, 'original_text', s.original_text, 'markers', s.markers, 'footnotes', {}, 'margin_notes', {}, 'figure_number', s.figure_number))"
    bare = bare.format(note.format("s.footnotes"), note.format("s.margin_notes"))
    shape = F.expr(f"transform(blocks, b -> named_struct('position', b.position, 'block', b.block, 'figure_number', b.figure_number, 'sentences', {bare.replace('(sentences,', '(b.sentences,')}))")
    return _held(t).select("node", F.md5(F.to_json(shape, {"ignoreNullFields": "false"})).alias("page"))


@query("""
WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY source) AS n, first_value(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS low FROM documents),
r AS (SELECT doc_id AS request, source, n, CASE WHEN doc_id % 2 = 0 THEN greatest(place - 3, 1) ELSE place + 1 END AS first, CASE WHEN doc_id % 2 = 0 THEN place - 1 ELSE least(place + 3, n) END AS last FROM n),
c AS (SELECT doc_id, sum(length(text) - length(replace(text, chr(10), '')) + 1) AS blocks FROM documents GROUP BY doc_id)
SELECT request, coalesce(first <= last AND last < r.n, false) AS has_more, CASE WHEN first > last THEN false WHEN request % 2 = 0 THEN first > 1 ELSE min(m.doc_id) > 0 END AS has_previous, coalesce(list(m.doc_id ORDER BY m.doc_id) FILTER (m.doc_id IS NOT NULL), []) AS nodes, coalesce(sum(c.blocks), 0)::BIGINT AS n_blocks
FROM r LEFT JOIN n m ON m.source = r.source AND m.place BETWEEN r.first AND r.last LEFT JOIN c ON c.doc_id = m.doc_id GROUP BY request, first, last, r.n""")
def node_pages(t):
    """Pages of three nodes around every document, forwards behind odd ones and backwards before even ones, with whole contents."""
    odd = F.col("doc_id") % 2 == 1
    requests = t.documents.select(F.col("doc_id").alias("request"), F.col("source").alias("book"), F.when(odd, F.col("doc_id")).alias("after"), F.when(~odd, F.col("doc_id")).alias("before"), F.lit(3).alias("size"))
    nodes = t.documents.select(F.col("source").alias("book"), F.col("doc_id").alias("node"), F.col("doc_id").alias("sort_order"))
    lines = t.documents.select(F.col("doc_id").alias("node"), F.posexplode(F.split("text", "\n")).alias("position", "line"))
    held = N.with_children(lines.select("node").distinct(), "node", lines, "blocks", "position")
    found = N.pages(requests, nodes, held)
    count = F.aggregate("nodes", F.lit(0).cast("long"), lambda a, x: a + F.size(x["blocks"]))
    return found.select("request", "has_more", "has_previous", F.transform("nodes", lambda x: x["node"]).alias("nodes"), count.alias("n_blocks"))


@query(r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS corpus, row_number() OVER (PARTITION BY coalesce(lang, 'und') ORDER BY doc_id) - 1 AS i, string_split(text, chr(10))[1] AS label FROM documents),
p AS (SELECT doc_id, CASE corpus WHEN 'de' THEN (SELECT list_reduce([i + 1, 3, 4, 9], lambda a, g: a + CASE WHEN a >= g THEN 1 ELSE 0 END)) ELSE i + 1 END AS place,
  trim(regexp_replace(translate(CASE corpus WHEN 'en' THEN replace(label, '&', ' and') WHEN 'de' THEN replace(replace(replace(replace(replace(replace(replace(label, 'ä', 'ae'), 'Ä', 'ae'), 'ö', 'oe'), 'Ö', 'oe'), 'ü', 'ue'), 'Ü', 'ue'), 'ß', 'ss')
  ELSE replace(label, 'ſ', 's') END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM d)
SELECT doc_id, place AS sort_order, lpad(place::VARCHAR, greatest(length(place::VARCHAR), 3)::INTEGER, '0') AS source_ref, replace(slug, '_', '-') AS slug, lpad(place::VARCHAR, greatest(length(place::VARCHAR), 3)::INTEGER, '0') || '_' || slug || '.md' AS filename FROM p""")
def corpus_file_names(t):
    """Documents as files of their language's corpus, each corpus with its rules for places and slugs."""
    corpus = F.coalesce("lang", F.lit("und"))
    order = Window.partitionBy("corpus").orderBy("doc_id")
    files = t.documents.select("doc_id", corpus.alias("corpus"), F.get(F.split("text", "\n"), F.lit(0)).alias("label")).withColumn("file_index", F.row_number().over(order) - 1)
    rest = C.Rules(C.file_slug(C.LONG_S), C.places_without([]))
    own = {"de": C.Rules(C.file_slug(C.GERMAN), C.places_without([3, 4, 9])), "en": C.Rules(C.file_slug(C.AMPERSAND), C.places_without([]))}
    known = files.withColumn("corpus", F.when(F.col("corpus").isin(*own), F.col("corpus")).otherwise("other"))
    return C.named(known, own | {"other": rest}).select("doc_id", "sort_order", "source_ref", "slug", "filename")
