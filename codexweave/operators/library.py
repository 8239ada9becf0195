"""A library's catalogue: versions gathered into works, works into groups by author or under their own name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import staged
from . import hierarchy as T


def versions(books: DataFrame, anchors: DataFrame) -> DataFrame:
    """source, language, slug, node: books (book, source, language, slug), and nodes inside them that are sources of their own (book, source, node)."""
    inside = anchors.join(books.select("book", "language", "slug"), "book").select("source", "language", "slug", "node")
    return books.select("source", "language", "slug", F.lit(None).cast("string").alias("node")).unionByName(inside)


def works(sources: DataFrame, found: DataFrame) -> DataFrame:
    """work, parent, title, year, versions: versions that translate one source, through any number of steps, are one work.

    Versions of the source itself come first, then by language and slug; the first English one gives the title, if there is one; versions of unknown sources are left out.
    """
    root = T.roots(sources, "source", "translation_of").select("source", F.col("root").alias("work"))
    title = sources.select("source", F.col("title").alias("_title"))
    order = [(F.col("source") != F.col("work")).alias("other"), "language", "slug", F.coalesce("node", F.lit("")).alias("node"), "source"]
    listed = found.join(root.join(title.hint("merge"), "source").hint("merge"), "source").groupBy("work").agg(F.array_sort(F.collect_list(F.struct(*order, "_title"))).alias("_all"))
    english = F.get(F.filter("_all", lambda v: v["language"] == "en"), F.lit(0))["_title"]
    own = sources.select(F.col("source").alias("work"), "parent", "title", F.coalesce("original", "published").alias("year"))
    kept = F.transform("_all", lambda v: F.struct(v["language"].alias("language"), v["slug"].alias("slug"), F.nullif(v["node"], F.lit("")).alias("node"), v["source"].alias("source")))
    return listed.join(own.hint("merge"), "work").select("work", "parent", F.coalesce(english, "title").alias("title"), "year", kept.alias("versions"))


def contributors(persons: DataFrame) -> DataFrame:
    """work, authors, editors: each a source's persons of that role by position, from source, role, position, person, name, sort_name."""

    def of(role: str) -> Column:
        some = F.collect_list(F.when(F.col("role") == role, F.struct("position", "person", "name", F.coalesce("sort_name", "name").alias("sort_name"))))
        return F.array_sort(some).alias(role + "s")

    return persons.filter(F.col("role").isin("author", "editor")).groupBy(F.col("source").alias("work")).agg(of("author"), of("editor"))


def library(sources: DataFrame, found: DataFrame, persons: DataFrame) -> DataFrame:
    """kind, key, label, sort_name, works: the groups of a catalogue.

    ``sources`` has source, title, published, original, translation_of, parent. A work without a parent goes to its first author, else its first editor, else it
    is a group of its own, which lists it only if it has several versions. All tables here grow with the library, so they are joined by shuffles. Works with a parent go to the group of the topmost one, if that is itself a listed work.
    Works are sorted by year, undated ones last, then by title. A group's works are gathered in one row: as many as one author has, not as many as there are.
    """
    people, every = contributors(persons), works(sources, found)
    every = every.join(people.hint("merge"), "work", "left")
    by_author, editors = F.size("authors") > 0, F.col("editors")
    lead = F.get(F.when(by_author, F.col("authors")).otherwise(editors), F.lit(0))
    others = F.when(by_author, F.transform(F.slice("authors", 2, 1 << 30), lambda p: p["name"]))
    named = F.when(~by_author & (F.size("editors") > 0), F.transform(editors, lambda p: p["name"]))
    card = F.struct(F.col("year").isNull().alias("undated"), "year", "title", "work", F.coalesce(others, F.array().cast("array<string>")).alias("co_authors"), named.alias("editors"), "versions")
    placed = staged(every.select("work", "parent", "title", card.alias("card"), lead.alias("lead")))

    kind = F.when(F.col("lead").isNull(), "self").otherwise("author")
    key = F.when(F.col("lead").isNull(), F.col("work")).otherwise(F.col("lead.person"))
    top = placed.filter("parent is null").join(sources.select(F.col("source").alias("work"), F.col("title").alias("_own")).hint("merge"), "work")
    top = top.select("work", "card", kind.alias("kind"), key.alias("key"), F.coalesce("lead.name", "_own").alias("label"), F.coalesce("lead.sort_name", "_own").alias("sort_name"))
    shown = F.when((F.col("kind") == "author") | (F.size("card.versions") > 1), F.col("card"))
    heads = top.withColumn("card", shown)
    above = T.roots(sources, "source", "parent").select(F.col("source").alias("work"), F.col("root").alias("_top"))
    nested = placed.filter("parent is not null").select("work", "card").join(above.hint("merge"), "work").drop("work")
    nested = nested.join(top.drop("card").hint("merge"), F.col("_top") == F.col("work")).select(*heads.columns)
    listed = F.array_sort(F.collect_list("card"), lambda a, b: _by_year_and_title(a, b))
    return heads.unionByName(nested).groupBy("kind", "key").agg(F.min("label").alias("label"), F.min("sort_name").alias("sort_name"), listed.alias("works"))


def _by_year_and_title(a: Column, b: Column) -> Column:
    keys = [F.struct(x["undated"], x["year"], x["title"], x["work"]) for x in (a, b)]
    return F.when(keys[0] < keys[1], -1).when(keys[0] > keys[1], 1).otherwise(0)
