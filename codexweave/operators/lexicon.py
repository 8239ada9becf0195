"""Old spellings: a lexicon from pairs of printed and normal forms, what needs a ruling, and texts in modern spelling."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import bound
from .lineage import staged

#: Classes of spelling rules with what each replaces, first class first.
RULES = {
    "ey_ei": [("ey", "ei"), ("Ey", "Ei")],
    "th_t": [("th", "t"), ("Th", "T")],
    "ff_f": [("ff", "f")],
    "c_k": [("c", "k"), ("C", "K")],
}


def spelling_class(surface: Column, norm: Column) -> Column:
    """'identity', 'long_s', the first class of the smallest set of rules that turns ``surface`` into ``norm``, or 'residual'; of sets of one size, that whose last rule comes first."""
    folded = F.replace(surface, F.lit("ſ"), F.lit("s"))
    out = F.when(surface == norm, F.lit("identity")).when(folded == norm, F.lit("long_s"))
    names = list(RULES)
    for size in range(1, len(names) + 1):
        for chosen in sorted(combinations(range(len(names)), size), key=lambda c: c[::-1]):
            form = folded
            for i in chosen:
                for old, new in RULES[names[i]]:
                    form = F.replace(form, F.lit(old), F.lit(new))
            out = out.when(form == norm, F.lit(names[chosen[0]]))
    return out.otherwise(F.lit("residual"))


def lexicon(pairs: DataFrame, rulings: DataFrame) -> DataFrame:
    """surface, norm, n, class, result, report, from pairs (surface, norm) and rulings (surface, ruling).

    ``norm`` is the surface's most frequent one (of ties the greatest), ``n`` counts the pairs, ``result`` is the modern form, null where the surface stays
    as it is, and ``report`` says why a ruling is needed. Pairs are counted by both forms first, so a frequent surface is a few rows a task. Rulings without pairs are in, with n 0.
    """
    votes = pairs.groupBy("surface", "norm").agg(F.count("*").alias("n"))
    best = votes.groupBy("surface").agg(F.max(F.struct("n", "norm"))["norm"].alias("norm"), F.sum("n").alias("n"))
    # Forms need no rules where a ruling stands, so those surfaces aren't classified.
    both = best.join(rulings, "surface", "full").withColumn("class", F.when(F.col("ruling").isNotNull(), "ruling").otherwise(spelling_class(F.col("surface"), F.col("norm"))))
    named, norm = F.col("class"), F.col("norm")
    explained = ~named.isin("ruling", "identity", "residual")
    report = F.when(named == "ruling", None).when(named == "residual", "residual").when(explained & norm.contains("ss"), "ss_audit").when(norm.rlike("ſ|ey|Ey"), "cab_unnormalized")
    result = F.when(named == "ruling", F.col("ruling")).when(explained & report.isNull(), norm)
    return both.select("surface", "norm", F.coalesce("n", F.lit(0)).alias("n"), "class", result.alias("result"), report.alias("report"))


def modernised(texts: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    """key, modern, keeps_long_s: each run of letters replaced by its ``result`` in ``entries`` (surface, result), all else as it is; ``key`` names a text.

    Only the distinct words of all texts meet the lexicon, and only places to change meet their texts, under a digest: no word carries its text.
    """
    runs = F.regexp_extract_all("_text", F.lit(r"\p{IsAlphabetic}+|\P{IsAlphabetic}+"), F.lit(0))
    named = texts.select(key, F.col(text).alias("_text"), F.unhex(F.sha2(F.col(text), 256)).alias("_id"))
    places = named.select("_id", F.posexplode(runs).alias("_at", "surface")).filter(F.col("surface").rlike(r"^\p{IsAlphabetic}"))
    known = entries.filter("result is not null").select("surface", "result")
    # A table of its own, whose size tells whether it can be sent to all tasks.
    used = staged(known.join(places.select("surface").distinct(), "surface", "left_semi"))
    put = places.join(used, "surface").groupBy("_id").agg(F.array_sort(F.collect_set(F.struct(F.col("_at").alias("at"), F.lit(0).alias("old"), F.col("result").alias("s")))).alias("_put"))

    def changed(x: Column) -> Column:
        """Of two runs of one place the new one, which sorts first."""
        return F.filter(x, lambda r, i: (i == 0) | (F.get(x, i - 1)["at"] != r["at"]))

    said = F.transform(runs, lambda s, i: F.struct(i.alias("at"), F.lit(1).alias("old"), s.alias("s")))
    whole = bound(F.array_sort(F.concat("_put", said)), lambda x: F.array_join(F.transform(changed(x), lambda r: r["s"]), ""))
    every = named.join(put, "_id", "left").select(key, F.when(F.col("_put").isNull(), F.col("_text")).otherwise(whole).alias("modern"))
    return every.withColumn("keeps_long_s", F.col("modern").contains("ſ"))
