"""Phrases of a dictionary in texts, slices of respelled words, and corrections.

Matches are an equi-join of word runs with the dictionary, one run for each length that the dictionary has; at each place the longest
stays, and of matches that overlap the earlier one. Alignment is by edit distance of prefixes, all in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import bound


def phrase_matches(texts: DataFrame, key: str, words: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """key, place (word number from 0), size, phrase: the longest phrases from left to right, none overlapping.

    ``words`` is an array; ``phrases`` are distinct, with single spaces; their lengths in words are few. Runs that are looked up are hashed, so that only
    key, place and hash are exploded; the phrase itself is compared where hashes meet. One text's matches are gathered in a row.
    """
    known = phrases.select(F.col(phrase).alias("phrase")).distinct().withColumn("size", F.size(F.split("phrase", " "))).withColumn("h", F.xxhash64("phrase"))
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())
    empty = F.array().cast("array<struct<place:int,size:int,h:bigint>>")

    def runs(n: int) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - n)
        each = F.transform(places, lambda i: F.struct(i.alias("place"), F.lit(n).alias("size"), F.xxhash64(F.array_join(F.slice(words, i + 1, F.lit(n)), " ")).alias("h")))
        return F.when(F.size(words) >= n, each).otherwise(empty)

    spread = texts.select(key, F.explode(F.concat(empty, *[runs(n) for n in sizes])).alias("r")).select(key, "r.*")
    hits = spread.join(known, ["h", "size"]).select(key, "place", "size", "phrase")
    real = hits.join(texts.select(key, words), key).filter(F.array_join(F.slice(words, F.col("place") + 1, F.col("size")), " ") == F.col("phrase"))
    longest = real.groupBy(key, "place").agg(F.max(F.struct("size", "phrase")).alias("m"))
    kind = "array<struct<place:int,size:int,phrase:string>>"
    start = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("out"))

    def take(acc: Column, m: Column) -> Column:
        free = m["place"] >= acc["end"]
        return F.struct(F.when(free, m["place"] + m["size"]).otherwise(acc["end"]).alias("end"), F.when(free, F.concat(acc["out"], F.array(m))).otherwise(acc["out"]).alias("out"))

    lists = longest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", F.col("m.size").alias("size"), F.col("m.phrase").alias("phrase")))).alias("all"))
    return lists.select(key, F.explode(F.aggregate("all", start, take)["out"]).alias("m")).select(key, "m.*")


def slices(word: Column, target: Column, cuts: Column) -> Column:
    """``target`` cut where an alignment with ``word`` puts the word's cuts; the parts make up the target again.

    The alignment is walked from the end, by a substitution where that keeps the distance, else by a deletion, else by an insertion.
    """
    n, m = F.char_length(word), F.char_length(target)

    def distance(i: Column, j: Column) -> Column:
        return F.levenshtein(F.substring(word, F.lit(1), i), F.substring(target, F.lit(1), j))

    def step(acc: Column, _: Column) -> Column:
        i, j = acc["i"], acc["j"]
        here = distance(i, j)
        differ = (F.substring(word, i, F.lit(1)) != F.substring(target, j, F.lit(1))).cast("int")
        both = (i > 0) & (j > 0) & (here == distance(i - 1, j - 1) + differ)
        gone = (i > 0) & (here == distance(i - 1, j) + 1)
        k, q = F.when(both | gone, i - 1).otherwise(i), F.when(both | ~gone, j - 1).otherwise(j)
        moved = F.struct(k.alias("i"), q.alias("j"), F.concat(acc["path"], F.array(F.struct(k.alias("i"), q.alias("j")))).alias("path"))
        return F.when((i > 0) | (j > 0), moved).otherwise(acc)

    start = F.struct(n.alias("i"), m.alias("j"), F.array(F.struct(n.alias("i"), m.alias("j"))).alias("path"))
    path = F.aggregate(F.sequence(F.lit(0), n + m), start, step)["path"]

    def cut(walked: Column) -> Column:
        images = F.transform(cuts, lambda c: F.array_min(F.transform(F.filter(walked, lambda p: p["i"] == c), lambda p: p["j"])))

        def parts(at: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda k: F.substring(target, F.get(at, k - 1) + 1, F.get(at, k) - F.get(at, k - 1)))

        return bound(F.concat(F.array(F.lit(0)), images, F.array(m)), parts)

    return bound(path, cut)


def corrected(texts: DataFrame, corrections: DataFrame, key: str, text: str) -> DataFrame:
    """The texts with their corrections (key, number, search, replace) made in order, each of which must match once: adds ``refused``, the numbers that did not."""
    listed = corrections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("number", "search", "replace"))).alias("_c"))

    def step(acc: Column, c: Column) -> Column:
        now, search = acc["text"], c["search"]
        without = F.replace(now, search, F.lit(""))
        once = (search != "") & (F.char_length(now) - F.char_length(without) == F.char_length(search))
        done = F.struct(F.replace(now, search, c["replace"]).alias("text"), acc["refused"].alias("refused"))
        return F.when(once, done).otherwise(F.struct(now.alias("text"), F.concat(acc["refused"], F.array(c["number"])).alias("refused")))

    empty = F.array().cast(f"array<{corrections.schema['number'].dataType.simpleString()}>")
    joined = texts.join(listed, key, "left")
    folded = F.aggregate(F.coalesce("_c", F.array().cast(listed.schema["_c"].dataType)), F.struct(F.col(text).alias("text"), empty.alias("refused")), step)
    return joined.withColumn("_f", folded).withColumn(text, F.col("_f.text")).withColumn("refused", F.col("_f.refused")).drop("_c", "_f")
