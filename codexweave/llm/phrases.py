"""Phrase collocation mining (12): contiguous patterns grown to the right over projected occurrences, depth-first.

Words are counted, then pairs of frequent words, these by hashes alone. The occurrences of frequent pairs are projected: each gives the
words from it onwards, five at most, up to the first pair that is not frequent (no phrase that reaches over it can be). Projections are
range-sorted, so that all occurrences of a prefix lie together: a task takes its prefixes one by one, splits a prefix's occurrences by the
next word and goes on into each part that is frequent, deepest first. A hot prefix is simply spread over several ranges: runs that touch
the edge of a batch pass their support on as it is, and supports are summed at the end.

Which words and pairs are frequent is known to tasks by a bitmap of 2 ** BITS hashes, 16 MB whatever the input: it lets every frequent
one through and a few others, whose counts then fail. All counts that are returned are of strings, scores are decimals of 38 digits.

A null text is an empty one, a null language is ``und`` like the language of that name; rows of one doc_id are different documents; very
long texts are read whole; equal scores follow by support, then phrase; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, lean, partitions, small
from .words import EVERY_BYTE, U, hash_spans, mix, raw, slices

LEAST, LONGEST, TOP, BITS, BUCKET = 100, 5, 2000, 27, 1 << 22
COUNTED = "lang string, phrase string, n long"

_SPLIT, _SPACE, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_SPLIT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE[[0x20, 0x09]] = True
_LOWER[65:91] += 32


@dataclass
class Text:
    """A batch's words, lower-cased, each with one space behind it: word j is ``data[start[j]:end[j]]``, of language ``lang[j]`` (a number in ``langs``)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lang: np.ndarray
    linked: np.ndarray
    langs: list[str]

    def word_hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U)
        of_lang = pa.array(self.langs, pa.string())
        data, bounds = raw(of_lang)
        filled = np.flatnonzero(np.diff(bounds))
        own = np.zeros(len(self.langs), U)
        own[filled] = hash_spans(data, bounds[:-1][filled], np.diff(bounds)[filled], EVERY_BYTE)
        return mix(hash_spans(self.data, self.start, self.end - self.start, EVERY_BYTE) + own[self.lang] * U(0x9E3779B97F4A7C15))

    def pair_hashes(self) -> np.ndarray:
        """By the pair's first word; meaningless for the last word."""
        h = self.word_hashes()
        return mix(h * U(3) + np.roll(h, -1))

    def counted(self, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        """How often each phrase from word ``first`` to word ``last`` occurs here, by language and string."""
        begin, length = self.start[first], self.end[last] - self.start[first]
        offsets = np.zeros(len(first) + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        place = np.arange(offsets[-1])
        place += np.repeat(begin - offsets[:-1], length)
        bytes_ = self.data[place]
        phrases = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)]).dictionary_encode()
        size = max(len(phrases.dictionary), 1)
        keys, n = np.unique(self.lang[first].astype(np.int64) * size + phrases.indices.to_numpy(zero_copy_only=False), return_counts=True)
        return pa.record_batch([pa.array(self.langs, pa.string()).take(pa.array(keys // size)), phrases.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def read(batch: pa.RecordBatch) -> Text:
    """lang, text of some rows as words; words of one piece are linked."""
    texts = pc.binary_join_element_wise(pc.fill_null(batch["text"], "").cast(pa.large_string()), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    data, bounds = raw(texts)
    cuts = _SPLIT[data]
    inside = ~(cuts | _SPACE[data])
    before = np.concatenate([[False], inside[:-1]])
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    pieces = np.cumsum(cuts, dtype=np.int32)
    linked = np.append(pieces[stop[:-1]] == pieces[start[1:] - 1], False) if len(start) else np.zeros(0, bool)
    linked[:-1] &= ~cuts[stop[:-1]]
    kept = inside | before
    place = np.cumsum(kept) - 1
    out = np.where(inside, _LOWER[data], 0x20).astype(np.uint8)[kept]
    langs = batch["lang"].dictionary_encode()
    row = np.searchsorted(bounds, start, "right") - 1
    return Text(out, place[start], place[stop], langs.indices.to_numpy(zero_copy_only=False)[row] if len(start) else np.zeros(0, np.int32), linked, langs.dictionary.to_pylist())


def _bitmap(slots: DataFrame):
    """A broadcast bitmap of 2 ** BITS bits from (block, bit)."""
    found = slots.groupBy("block").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[found["block"].to_numpy()] = found["bits"].to_numpy()
    return slots.sparkSession.sparkContext.broadcast(table.view(U))


def _slots(h: np.ndarray) -> pa.RecordBatch:
    slot = np.unique(h >> U(64 - BITS)).astype(np.int64)
    return pa.record_batch([pa.array(slot >> 6), pa.array((slot & 63).astype(np.int32))], names=["block", "bit"])


def word_bitmap(frequent: DataFrame):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _slots(read(batch).word_hashes())

    return _bitmap(frequent.select("lang", F.col("phrase").alias("text")).mapInArrow(run, "block long, bit int"))


def pair_bitmap(docs: DataFrame, known, total: int, least: int = LEAST):
    """The pairs that occur ``least`` times, by hashes: a bucket of them, sized by the number of words, is counted at a time.

    Hashes are sent as sorted arrays, a bucket's part of a few MB in one row: five bytes for each pair that differs within a flush.
    """
    high = max(4, (total // BUCKET).bit_length())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(waiting), return_counts=True)
            times = (n - 1) // 255 + 1
            keys, n = np.repeat(keys, times), np.minimum(np.repeat(n, times) - 255 * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)), 255)
            bucket = (keys >> U(32)).astype(np.int64)
            names, first, size = np.unique(bucket, return_index=True, return_counts=True)
            low, n = keys.astype(np.uint32), n.astype(np.uint8)
            waiting.clear()
            return pa.record_batch([pa.array(names), pa.array([low[a : a + k].tobytes() for a, k in zip(first, size)], pa.binary()), pa.array([n[a : a + k].tobytes() for a, k in zip(first, size)], pa.binary())], names=["bucket", "keys", "counts"])

        for batch in slices(batches, limit=2 << 20):
            text = read(batch)
            held = _held(known.value, text.word_hashes())
            waiting.append(text.pair_hashes()[text.linked & held & np.roll(held, -1)] >> U(32 - high))
            if sum(map(len, waiting)) > BUCKET:
                yield flush()
        if waiting:
            yield flush()

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = None, [], []

        def close() -> pa.RecordBatch:
            own, place = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(place, np.concatenate(counts))
            return _slots(((U(now) << U(32)) | own[n >= least].astype(U)) << U(32 - high))

        for batch in batches:
            for bucket, low, n in zip(batch["bucket"].to_pylist(), batch["keys"], batch["counts"]):
                if bucket != now and keys:
                    yield close()
                    keys, counts = [], []
                now = bucket
                keys.append(np.frombuffer(low.as_buffer(), np.uint32))
                counts.append(np.frombuffer(n.as_buffer(), np.uint8))
        if keys:
            yield close()

    rows = docs.mapInArrow(pack, "bucket long, keys binary, counts binary").repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    return _bitmap(rows.mapInArrow(often, "block long, bit int"))


def _held(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> U(64 - BITS)
    return (table[slot >> U(6)] >> (slot & U(63)) & U(1)).astype(bool)


def _counts(docs: DataFrame, run) -> DataFrame:
    """Counts by language and phrase from those that ``run`` makes of each batch."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            yield run(read(batch))

    return docs.mapInArrow(every, COUNTED)


def _words(text: Text) -> pa.RecordBatch:
    """Words, and the language's number of words as the empty phrase."""
    every = np.arange(len(text.start))
    found = text.counted(every, every)
    n = np.bincount(text.lang, minlength=len(text.langs))
    totals = pa.record_batch([pa.array(text.langs, pa.string()), pa.array([""] * len(n), pa.string()), pa.array(n, pa.int64())], names=found.schema.names)
    return pa.Table.from_batches([found, totals]).combine_chunks().to_batches()[0]


def _growth(least: int):
    """A task over sorted projections (lang, phrase with a last space, n), which gives the supports of phrases of two words and more."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            langs = batch["lang"].dictionary_encode()
            lists = pc.split_pattern(batch["phrase"], " ")
            parts = pc.list_flatten(lists).dictionary_encode()
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(size), counts)
            column = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            words = np.full((size, LONGEST + 1), -1, np.int64)
            inner = column < counts[row] - 1  # behind the last space there is no word
            words[row[inner], column[inner] + 1] = parts.indices.to_numpy(zero_copy_only=False)[inner]
            words[:, 0] = langs.indices.to_numpy(zero_copy_only=False)
            support = np.concatenate([[0], np.cumsum(batch["n"].to_numpy())])
            found: list[tuple[int, int, int]] = []

            def extend(low: int, high: int, depth: int) -> None:
                """Occurrences low:high share their language and ``depth - 1`` words."""
                here = words[low:high, depth]
                edges = [low, *(np.flatnonzero(here[1:] != here[:-1]) + low + 1).tolist(), high]
                for a, b in zip(edges, edges[1:]):
                    n = int(support[b] - support[a])
                    if words[a, depth] < 0 or (n < least and a > 0 and b < size):
                        continue
                    if depth >= 2:
                        found.append((a, depth, n))
                    if depth < LONGEST:
                        extend(a, b, depth + 1)

            extend(0, size, 0)
            names = parts.dictionary.to_pylist()
            phrases = [" ".join(names[w] for w in words[a, 1 : depth + 1]) for a, depth, _ in found]
            yield pa.record_batch([batch["lang"].take(pa.array([a for a, _, _ in found], pa.int64())), pa.array(phrases, pa.string()), pa.array([n for *_, n in found], pa.int64())], names=["lang", "phrase", "n"])

    return grown


def supports(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, n: all phrases of one to ``LONGEST`` words that occur at least ``least`` times, and the empty phrase: all words."""
    docs = lean(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    unigrams = _counts(docs, _words).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    unigrams = cut(unigrams.filter((F.col("n") >= least) | (F.col("phrase") == "")))
    total = unigrams.filter("phrase = ''").agg(F.sum("n")).first()[0] or 0
    joined = pair_bitmap(docs, word_bitmap(unigrams.filter("phrase <> ''")), total, least)

    def projected(text: Text) -> pa.RecordBatch:
        """From each frequent pair on, the words up to the first pair that is not frequent; the string keeps its last space, which holds prefixes together."""
        held = text.linked & _held(joined.value, text.pair_hashes())
        reach, going = np.zeros(len(held), np.int64), np.ones(len(held), bool)
        for k in range(LONGEST - 1):
            going = going & np.append(held[k:], np.zeros(min(k, len(held)), bool))
            reach += going
        first = np.flatnonzero(reach)
        kept = Text(text.data, text.start, text.end + 1, text.lang, text.linked, text.langs)
        return kept.counted(first, first + reach[first])

    spread = cut(_counts(docs, projected).groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    sorted_ = spread.repartitionByRange(partitions(docs.sparkSession), "lang", "phrase").sortWithinPartitions("lang", "phrase")
    longer = sorted_.mapInArrow(_growth(least), COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return cut(unigrams.unionByName(longer))


def _cuts(words: Column) -> Column:
    """Each way to cut a phrase in two: k, first, rest."""
    ways = F.sequence(F.lit(1), F.size(words) - 1)
    return F.transform(ways, lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("rest")))


def scored(found: DataFrame) -> DataFrame:
    """The candidates of ``supports`` that no longer one holds: lang, phrase, a, l, r, n, score."""
    words = F.split("phrase", " ")
    candidates = found.filter(F.size(words) > 1).select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))
    shorter = F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", 2, F.size("words")))
    # A phrase within a longer one of equal support is within one that is longer by a word and has that support too.
    inner = candidates.filter(F.size("words") > 2).select("lang", F.explode(F.transform(shorter, lambda x: F.array_join(x, " "))).alias("phrase"), "a")
    kept = candidates.join(inner, ["lang", "phrase", "a"], "left_anti")
    totals = found.filter("phrase = ''").select("lang", F.col("n").alias("total"))
    ways = kept.select("lang", "phrase", "a", F.explode(_cuts(F.col("words"))).alias("way")).select("lang", "phrase", "a", "way.*")
    part = small(found).select("lang", "phrase", "n")
    ways = ways.join(part.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    ways = ways.join(part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    ways = ways.join(F.broadcast(totals) if _few(totals) else totals, "lang")
    exact = F.expr("(1000 * cast(a as decimal(19,0)) * cast(total as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = ways.groupBy("lang", "phrase").agg(F.min(F.struct(exact.alias("score"), "k", "a", "l", "r", F.col("total").alias("n"))).alias("m"))
    return lowest.select("lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")


def _few(totals: DataFrame, most: int = 10_000) -> bool:
    return totals.limit(most + 1).count() <= most


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """Each language's first ``top``; a language's candidates are first ranked in shares, so that none need fit in one task."""
    found = scored(supports(docs, least))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    every = partitions(docs.sparkSession)
    ranked = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(every)))
    for shares in (every, math.isqrt(every), 1):
        window = Window.partitionBy("lang", F.col("share") % shares).orderBy(*order)
        ranked = ranked.withColumn("rank", F.row_number().over(window).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
f AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS n
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k)) GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
candidates AS (SELECT * FROM f WHERE k > 1),
kept AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.k > c.k AND d.n >= c.n AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT c.lang, c.phrase, c.n AS a, j, l.n AS l, r.n AS r, t.n AS n, (1000 * c.n::HUGEINT * t.n::HUGEINT) // (l.n::HUGEINT * r.n::HUGEINT) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS j FROM kept) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[j + 1:], ' ') JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000"""
