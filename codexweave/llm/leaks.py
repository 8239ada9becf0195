"""Benchmark decontamination (7): latent semantic retrieval, then common subsequences and answers.

The vocabulary is that of the benchmark's items; each document is reduced once to the places of these words, which is
all that later steps need. Document frequencies are counted over all passages (``PASSAGE`` words, half overlapping). The
TF-IDF matrix of all passages is sketched as A'(A W) by two sparse products in each task and sums by blocks of terms;
an orthonormal basis of the sketch is the latent space (randomised SVD, one power step), with W led by the
items' own vectors. Passages with a cosine of ``COSINE`` to an item are candidates, and are confirmed on the words around them: the longest
common subsequence must cover ``COVER`` of the item, or ``PARAPHRASE`` of it with its answer (the last sentence, or the last
``ANSWER`` words if that is short or the only one) covered to ``COVER``.

Items come to the driver in blocks of ``ITEMS`` items and about ``TERMS`` distinct words. Null or empty items and texts match nothing; items of fewer than ``SHORTEST``
words are left out, as they tell nothing; repeated rows are found each; rows of equal doc_id are one document in the result; a null doc_id is kept;
an empty table gives no rows; columns beyond the ids and texts are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, lean, small
from .words import U, bare, slices

PASSAGE, RANK, COSINE, COVER, PARAPHRASE, ANSWER, SHORTEST = 48, 256, 0.4, 0.75, 0.6, 8, 5
ITEMS, TERMS, COMMON, CHUNK = 20_000, 40_000, 0.002, 64
HALF = PASSAGE // 2


class Items:
    """One block of the benchmark: vocabulary (ascending hashes), items and answers as arrays of term numbers."""

    def __init__(self, ids: list, texts: list[str]):
        w, h = bare(pa.array(texts, pa.string()))
        keep = np.flatnonzero(w.counts >= SHORTEST)
        rows = [h[w.first[i] : w.first[i + 1]] for i in keep]
        self.terms = np.unique(np.concatenate([h[:0], *rows]))
        self.ids, self.items = [ids[i] for i in keep], [np.searchsorted(self.terms, x).astype(np.int32) for x in rows]
        self.answers = []
        for i, item in zip(keep, self.items):
            last = [x for x in re.split(r"[.!?]\s+", texts[i].strip()) if x.strip()][-1]
            n = len(bare(pa.array([last]))[1])
            self.answers.append(item[-(n if SHORTEST <= n < len(item) else ANSWER) :])
        self.weights = np.zeros(len(self.terms))
        self.basis = self.latent = None

    def weigh(self, frequency: np.ndarray, total: int) -> None:
        """Terms in more than ``COMMON`` of the passages don't count, but for each item's six rarest."""
        counts = frequency / max(total, 1) <= max(COMMON, 20 / max(total, 1))
        for item in self.items:
            own = np.unique(item)
            counts[own[np.argsort(frequency[own], kind="stable")[:6]]] = True
        self.weights = np.where(counts, np.log((total + 1) / (frequency + 1)) + 1, 0.0)

    def vectors(self) -> Iterator[tuple[slice, np.ndarray]]:
        """The items' unit TF-IDF vectors, some at a time: a matrix of all would be items times terms."""
        for at in range(0, len(self.items), 64):
            part = slice(at, min(at + 64, len(self.items)))
            out = np.zeros((part.stop - at, len(self.terms)))
            for i, item in enumerate(self.items[part]):
                np.add.at(out[i], item, 1)
            out = np.sqrt(out) * self.weights
            yield part, out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)


def reduced(docs: DataFrame, terms, text: str, key: str) -> DataFrame:
    """doc_id, row (hash of the text), n_words and the vocabulary's words as bytes: places (int32) and terms (int32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        quick = np.zeros(1 << 16, bool)
        quick[known & U(0xFFFF)] = True
        for batch in slices(batches):
            w, h = bare(batch["text"])
            hit = np.flatnonzero(quick[h & U(0xFFFF)])
            term = np.minimum(np.searchsorted(known, h[hit]), len(known) - 1)
            true = known[term] == h[hit]
            hit, term = hit[true], term[true].astype(np.int32)
            of = np.searchsorted(w.first, hit, side="right") - 1
            place = (hit - w.first[of]).astype(np.int32)
            cuts = np.searchsorted(of, np.arange(len(batch) + 1))
            both = [(place[a:b].tobytes(), term[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield pa.record_batch([batch["doc_id"], batch["row"], pa.array(w.counts), pa.array([x for x, _ in both], pa.binary()), pa.array([x for _, x in both], pa.binary())], names=["doc_id", "row", "n_words", "places", "terms"])

    rows = lean(docs).select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, n_words long, places binary, terms binary")


def _passages(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, passage, term) with how often, ascending: row, passage, number of the passage, term, count."""
    empty = np.zeros(0, np.int64)
    parts = []
    for row, (p, t) in enumerate(zip(batch["places"], batch["terms"])):
        place, term = np.frombuffer(p.as_buffer(), np.int32).astype(np.int64), np.frombuffer(t.as_buffer(), np.int32).astype(np.int64)
        at = place // HALF
        parts.append(np.concatenate([(row << 52) | (at << 24) | term, (row << 52) | ((at - 1)[at > 0] << 24) | term[at > 0]]))
    keys, count = np.unique(np.concatenate([empty, *parts]), return_counts=True)
    group = keys >> 24
    number = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) if len(keys) else empty
    return keys >> 52, (keys >> 24) & ((1 << 28) - 1), number, keys & ((1 << 24) - 1), count


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def frequencies(found: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """In how many passages each term is, over all documents, and how many passages there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in _parts(batches):
            total += np.bincount(_passages(batch)[3], minlength=n_terms)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for r in found.select("places", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out, found.agg(F.sum(F.greatest(F.ceil(F.col("n_words") / HALF), F.lit(1)))).first()[0] or 0


def _matrix(items: Items, batch: pa.RecordBatch):
    """Unit TF-IDF rows of passages that could match: row, passage per matrix row; then entries' row, term, value."""
    row, passage, number, term, count = _passages(batch)
    value = np.sqrt(count) * items.weights[term]
    keep = value > 0
    row, passage, number, term, value = row[keep], passage[keep], number[keep], term[keep], value[keep]
    n = np.bincount(number, minlength=0)
    keep = n[number] >= 2 if len(number) else keep[:0]
    row, passage, number, term, value = row[keep], passage[keep], number[keep], term[keep], value[keep]
    heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(number))))
    if len(heads):
        value = value / np.sqrt(np.add.reduceat(value * value, heads))[number]
    return row[heads], passage[heads], heads, number, term, value


def sketch(found: DataFrame, items, start: np.ndarray) -> np.ndarray:
    """A'(A W) over all passages' matrix A: summed by blocks of terms, in two levels."""
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast(start)
    n_terms, rank = start.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((n_terms, rank), np.float32)
        for batch in _parts(batches, 200):
            _, _, heads, number, term, value = _matrix(items.value, batch)
            if len(heads):
                y = np.add.reduceat(shared.value[term] * value[:, None], heads)
                order = np.argsort(term, kind="stable")
                firsts = np.flatnonzero(np.diff(term[order], prepend=-1))
                total[term[order[firsts]]] += np.add.reduceat(y[number[order]] * value[order, None], firsts)
        part = TaskContext.get().partitionId()
        for at in range(0, n_terms, CHUNK):
            block = total[at : at + CHUNK]
            if block.any():
                yield pa.record_batch([[at // CHUNK], [part % 64], [block.tobytes()]], names=["chunk", "salt", "block"])

    def summed(table: pa.Table) -> pa.Table:
        block = sum(np.frombuffer(x.as_buffer(), np.float32) for x in table["block"])
        return pa.table({"chunk": table["chunk"][:1], "salt": table["salt"][:1], "block": pa.array([block.tobytes()], pa.binary())})

    schema = "chunk long, salt long, block binary"
    parts = found.select("places", "terms").mapInArrow(run, schema).groupBy("chunk", "salt").applyInArrow(summed, schema).groupBy("chunk").applyInArrow(summed, schema)
    out = np.zeros((n_terms, rank))
    for r in parts.toLocalIterator():
        block = np.frombuffer(r["block"], np.float32).reshape(-1, rank)
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(block)] = block
    return out


class Ordered:
    """A sequence of terms, for the longest common subsequence with others."""

    def __init__(self, x: np.ndarray):
        self.size, self.places, self.times = len(x), {}, {}
        for i, t in enumerate(x.tolist()):
            self.places[t] = self.places.get(t, 0) | 1 << i
            self.times[t] = self.times.get(t, 0) + 1

    def at_most(self, terms: set[int]) -> int:
        """No common subsequence with a text of these terms is longer."""
        return sum(self.times[t] for t in self.times.keys() & terms)

    def common(self, y: list[int]) -> int:
        """Length of the longest common subsequence, by bits."""
        row = ones = (1 << self.size) - 1
        for t in y:
            if m := self.places.get(t):
                u = row & m
                row = ((row + u) | (row - u)) & ones
        return self.size - row.bit_count()


def matches(found: DataFrame, items) -> DataFrame:
    """doc_id, row, item_id, coverage, answered of confirmed candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        for batch in _parts(batches):
            row, passage, heads, number, term, value = _matrix(block, batch)
            out = []
            if len(heads):
                y = np.add.reduceat(block.basis[term] * value[:, None], heads)
                y = (y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-12)).astype(np.float32)
                near = np.concatenate([np.argwhere(y[a : a + 512] @ block.latent.T >= COSINE) + [a, 0] for a in range(0, len(y), 512)])
                best: dict[tuple[int, int], tuple[float, bool]] = {}
                ordered: dict[int, tuple[Ordered, Ordered]] = {}
                last, place, words = -1, [], []
                for i, k in near.tolist():
                    if (r := int(row[i])) != last:
                        last = r
                        place, words = (np.frombuffer(batch[c][r].as_buffer(), np.int32).tolist() for c in ("places", "terms"))
                    if k not in ordered:
                        ordered[k] = Ordered(block.items[k]), Ordered(block.answers[k])
                    item, answer = ordered[k]
                    first = int(passage[i]) * HALF
                    near_words = words[bisect_left(place, first - item.size) : bisect_left(place, first + PASSAGE + item.size)]
                    if item.at_most(set(near_words)) < PARAPHRASE * item.size:
                        continue
                    cover = item.common(near_words) / item.size
                    answered = cover >= PARAPHRASE and answer.common(near_words) >= COVER * answer.size
                    if cover >= COVER or answered:
                        best[r, k] = max(best.get((r, k), (0.0, False)), (cover, answered))
                out = [(batch["doc_id"][r].as_py(), batch["row"][r].as_py(), block.ids[k], *v) for (r, k), v in best.items()]
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "row", "item_id", "coverage", "answered"])

    return found.select("doc_id", "row", "places", "terms").mapInArrow(run, "doc_id long, row long, item_id long, coverage double, answered boolean")


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Which documents hold which items: doc_id, item_id, coverage, answered."""
    found = contaminated(docs, benchmark, text, key)
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("answered").alias("answered"))


def cleared(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no item; rows of one id, or without one, are decided on each."""
    gone = small(cut(contaminated(docs, benchmark, text, key).select("doc_id", "row").distinct()))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    mine = F.col("d").getField(key).cast("long").eqNullSafe(F.col("x.doc_id")) & (F.xxhash64(F.col("d").getField(text)) == F.col("x.row"))
    return rows.join(gone.alias("x"), mine, "left_anti").select("d.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, row (hash of the text), item_id, coverage, answered."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id long, row long, item_id long, coverage double, answered boolean")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").toLocalIterator()
    block: list = []

    def take(block: list) -> DataFrame:
        items = Items([r["item_id"] for r in block], [r["text"] for r in block])
        if not items.items:
            return out
        found = cut(reduced(docs, spark.sparkContext.broadcast(items.terms), text, key))
        items.weigh(*frequencies(found, len(items.terms)))
        rank = min(RANK, len(items.terms))
        rng = np.random.default_rng(8)
        start = rng.normal(size=(len(items.terms), rank)) / np.sqrt(rank)
        mixed = np.zeros_like(start)
        for part, own in items.vectors():
            if len(items.items) > rank:
                mixed += own.T @ rng.normal(size=(len(own), rank))
            else:
                mixed[:, part] = own.T
        shared = spark.sparkContext.broadcast(items)
        items.basis = np.linalg.qr(sketch(found, shared, (mixed + 0.05 * start).astype(np.float32)) + 1e-3 * mixed)[0].astype(np.float32)
        latent = np.concatenate([own @ items.basis for _, own in items.vectors()])
        items.latent = (latent / np.maximum(np.sqrt((latent * latent).sum(1, keepdims=True)), 1e-12)).astype(np.float32)
        return cut(matches(found, spark.sparkContext.broadcast(items)).groupBy("doc_id", "row", "item_id").agg(F.max("coverage").alias("coverage"), F.max("answered").alias("answered")))

    words: set[str] = set()
    for r in rows:
        block.append(r)
        words.update(r["text"].lower().split())
        if len(block) == ITEMS or len(words) > TERMS:
            out, block, words = out.unionByName(take(block)), [], set()
    return out.unionByName(take(block)) if block else out


def op7_latent_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, benchmark)
