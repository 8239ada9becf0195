"""Substring dedup (8): recompression names runs and pairs of words; shared symbols reveal the long repeats.

Names are hashes of what they stand for, so equal runs and pairs get one name everywhere without being
exchanged. One round names double words, each further one the pairs whose left symbol's hash is even and whose right
one's is odd; a symbol's fate hangs on one neighbour, so two equal windows of ``WINDOW`` words have
the same symbols but for ``EDGE`` words at either end (2 + 2 + 4), and symbols have 8 words at most: each
window has a symbol inside. The longest one is the window's anchor (then the least name, then the first). Equal windows have
equal anchors with equal ``EDGE`` words around them; so only windows whose anchor, with that context,
occurs twice can be repeats. The windows of one anchor are a run: where a whole run, by the hash of all its windows, occurs twice, all of them are
repeats. Only where runs with one anchor differ, one of each kind is compared by windows, by the hash of all their words together with their anchor's.

Of texts that are wholly equal, all windows are repeats; only one of them takes part in the comparison of windows. Null and
blank texts have no words; repeated rows count as copies; a null doc_id is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, lean, sifted, small
from .words import U, Words, hashes, mix, ragged, seeded, slices, split, windows

WINDOW, PAIR_ROUNDS, EDGE, LONGEST = 35, 2, 8, 8
_PAIR, _CONTEXT, _RUN = seeded(4, 21), seeded(2 * EDGE + 1, 22), seeded(WINDOW + 2, 23)


def symbols(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and name of the symbols that words (hash, number of their text) are compressed to."""
    start, length, name = np.arange(len(h)), np.ones(len(h), np.int64), h

    def joined(left: np.ndarray, m: np.ndarray) -> None:
        nonlocal start, length, name
        name, length = name.copy(), length.copy()
        name[left] = mix(name[left] * m[0] + name[left + 1] * m[1])
        length[left] += length[left + 1]
        keep = np.ones(len(name), bool)
        keep[left + 1] = False
        start, length, name = start[keep], length[keep], name[keep]

    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        padded = np.concatenate([[False], same, [False]])
        joined(np.flatnonzero(same & ~padded[:-2] & ~padded[2:]), _PAIR[:2])
    for _ in range(PAIR_ROUNDS):
        if len(name) > 1:
            odd = (name & U(1)).astype(bool)
            joined(np.flatnonzero(~odd[:-1] & odd[1:] & (text[start[1:]] == text[start[:-1]])), _PAIR[2:])
            name = mix(name + U(1))
    return start, length, name


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts (word numbers), their anchors' words, and per window the anchor's key and the window's hash."""
    h = hashes(w)
    counts = w.counts
    text = np.repeat(np.arange(len(counts)), counts)
    s = np.flatnonzero(np.arange(len(h)) + WINDOW <= w.first[1:][text]) if len(h) else np.zeros(0, np.int64)
    if not len(s):
        return s, s, np.zeros(0, U), np.zeros(0, U)
    start, length, name = symbols(h, text)
    worth = (U(LONGEST) - length.astype(U) << U(60)) | (name >> U(4))
    begun, ended = np.zeros(len(h) + 2, np.int64), np.zeros(len(h) + 2, np.int64)
    begun[start + 1] = 1
    ended[start + length] = 1
    low, high = np.cumsum(begun)[s + EDGE], np.cumsum(ended)[s + WINDOW - EDGE]
    best = [np.arange(len(name))]
    for k in range(4):
        x, step = best[-1], 1 << k
        y = x[step:]
        x = x[: len(y)]
        best.append(np.where(worth[y] < worth[x], y, x))
    level = np.floor(np.log2(np.maximum(high - low, 1))).astype(np.int64)
    pick = np.zeros(len(s), np.int64)
    for k in range(5):
        at = np.flatnonzero(level == k)
        x, y = best[k][low[at]], best[k][high[at] - (1 << k)]
        pick[at] = np.where(worth[y] < worth[x], y, x)
    around = name * _CONTEXT[-1]
    for i in range(EDGE):
        around += h[np.maximum(start - 1 - i, 0)] * _CONTEXT[i] + h[np.minimum(start + length + i, len(h) - 1)] * _CONTEXT[EDGE + i]
    return s, start[pick], mix(around)[pick], windows(h, WINDOW)[s]


def _local(w: Words, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the place in it of each word number."""
    text = np.searchsorted(w.first, s, side="right") - 1
    return text, s - w.first[text]


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return lean(docs).select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("row"), F.xxhash64(F.lit(1), body).alias("side"), body.alias("text"))


def _begun(at: np.ndarray) -> np.ndarray:
    """Where the runs of windows with one anchor begin."""
    return np.flatnonzero(np.diff(at, prepend=-1))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: the number of words, the digest of all of them, and its runs: first window, number of windows, anchor's key, hash."""
    for batch in slices(batches):
        w = split(batch["text"])
        s, at, keys, whole = anchors(w)
        one = _begun(at)
        size = np.diff(one, append=len(at))
        runs = np.zeros(0, U)
        if len(one):
            inside = np.arange(len(at)) - np.repeat(one, size)
            runs = mix(np.add.reduceat(whole * _RUN[inside], one) + (at - s)[one].astype(U) * _RUN[-1] + size.astype(U) * _RUN[-2])
        text, place = _local(w, s[one])
        n = np.bincount(text, minlength=len(batch))
        digest = [hashlib.sha256(b" ".join(x.as_buffer().to_pybytes().split())).hexdigest() for x in batch["text"]]
        told = [ragged(place.astype(np.int32), n, pa.int32()), ragged(size.astype(np.int32), n, pa.int32()), ragged(keys[one].view(np.int64), n, pa.int64()), ragged(runs.view(np.int64), n, pa.int64())]
        yield pa.record_batch([batch["doc_id"], batch["row"], batch["side"], pa.array(w.counts), pa.array(digest), *told], names=["doc_id", "row", "side", "n_words", "digest", "starts", "sizes", "keys", "runs"])


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the runs that begin at ``shared``: row, start, anchor's key, window's hash."""
    for batch in slices(batches):
        w = split(batch["text"])
        s, at, keys, whole = anchors(w)
        one = _begun(at)
        text, place = _local(w, s[one])
        shared = batch["shared"]
        wanted = (np.repeat(np.arange(len(batch)), shared.value_lengths().to_numpy()) << 32) + shared.flatten().to_numpy()
        hit = np.repeat(np.isin((text << 32) + place, wanted), np.diff(one, append=len(at)))
        text, place = _local(w, s[hit])
        yield pa.record_batch([batch["row"].take(pa.array(text)), pa.array(place.astype(np.int32)), pa.array(keys[hit].view(np.int64)), pa.array(whole[hit].view(np.int64))], names=["row", "start", "key", "hash"])


def _third_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without the words of their repeated stretches."""
    for batch in slices(batches):
        texts, removed = [], []
        for body, low, high in zip(batch["text"], batch["low"], batch["high"]):
            words = body.as_buffer().to_pybytes().split()
            gone = np.zeros(len(words), bool)
            for a, b in zip(low.as_py(), high.as_py()):
                gone[a:b] = True
            texts.append(b" ".join([x for x, g in zip(words, gone.tolist()) if not g]).decode())
            removed.append(int(gone.sum()))
        yield pa.record_batch([batch["doc_id"], batch["row"], pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "row", "n_removed", "kept"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of a text, each with the number of those that follow it in its run, as the stretches of words they cover."""
    for batch in batches:
        low, high = [], []
        for found in batch["found"]:
            start, size = (found.values.field(c).to_numpy() for c in ("start", "size"))
            order = np.argsort(start, kind="stable")
            at, last = start[order], np.maximum.accumulate((start + size - 1)[order])
            first = np.flatnonzero(np.append(True, at[1:] - last[:-1] > WINDOW))
            low.append(at[first])
            high.append(last[np.append(first[1:] - 1, len(at) - 1)] + WINDOW)
        yield pa.record_batch([batch["row"], pa.array(low, pa.list_(pa.int32())), pa.array(high, pa.list_(pa.int32()))], names=["row", "low", "high"])


def repeated(df: DataFrame, by: list[str]) -> DataFrame:
    """The values of ``by`` in two rows at least; counted before the shuffle, so hot values are one row a task."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by)


def long_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per document what the first pass found; texts with copies (row, side, copies); repeated stretches by text (row, low, high)."""
    rows = _rows(docs, text, key)
    first = cut(rows.mapInArrow(_first_pass, "doc_id long, row long, side long, n_words long, digest string, starts array<int>, sizes array<int>, keys array<long>, runs array<long>"))
    texts = cut(first.groupBy("row", "side").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    found = first.select("row", F.explode(F.arrays_zip("starts", "sizes", "keys", "runs")).alias("x"))
    found = found.select("row", F.col("x.starts").alias("start"), F.col("x.sizes").alias("size"), F.col("x.keys").alias("key"), F.col("x.runs").alias("run"))
    shared = cut(found.groupBy("key").agg(F.count("*").alias("n"), (F.min("run") != F.max("run")).alias("differ")).filter("n > 1").select("key", "differ"))
    hits = cut(found.join(shared.hint("merge"), "key"))
    kinds = cut(hits.filter("differ").groupBy("key", "run").agg(F.count("*").alias("n"), F.min(F.struct("row", "start")).alias("one")))
    wanted = kinds.select("one.*").groupBy("row").agg(F.collect_set("start").alias("shared"))
    wanted = cut(wanted.join(texts, "row").select("row", "doc_id", "shared"))
    chosen = small(wanted)
    bodies = sifted(rows, "row", wanted).alias("r").join(chosen, (F.col("r.row") == chosen.row) & F.col("r.doc_id").eqNullSafe(chosen.doc_id)).select("r.row", "r.text", "shared")
    windowed = cut(bodies.mapInArrow(_second_pass, "row long, start int, key long, hash long"))
    again = cut(repeated(windowed, ["key", "hash"])).hint("merge")
    alone = windowed.join(again, ["key", "hash"], "left_semi").select("row", "start", F.lit(1).alias("size"))
    whole = hits.filter("NOT differ").select("row", "start", "size")
    alike = hits.filter("differ").join(kinds.filter("n > 1").select("key", "run"), ["key", "run"], "left_semi").select("row", "start", "size")
    parts = whole.unionByName(alike).unionByName(alone).join(texts.filter("copies > 1").select("row"), "row", "left_anti")
    starts = parts.groupBy("row").agg(F.collect_set(F.struct("start", "size")).alias("found"))
    return first, texts.select("row", "side", "copies"), cut(starts.mapInArrow(_runs, "row long, low array<int>, high array<int>"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (null where nothing goes), digest of the kept words."""
    first, texts, stretches = long_repeats(docs, text, key)
    rows = _rows(docs, text, key)
    chosen = small(stretches)
    bodies = sifted(rows, "row", stretches).join(chosen, "row").select("doc_id", "row", "text", "low", "high")
    partly = bodies.mapInArrow(_third_pass, "doc_id long, row long, n_removed long, kept string")
    partly = partly.withColumn("kept_sha256", F.sha2("kept", 256)).toDF("_id", "_row", "n_removed", "kept", "kept_sha256")
    partly = cut(partly.dropDuplicates(["_id", "_row"]))
    every = first.select("doc_id", "row", "side", "n_words", "digest").join(texts.filter("copies > 1"), ["row", "side"], "left")
    every = every.join(partly, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    whole = F.col("copies").isNotNull() & (F.col("n_words") >= WINDOW)
    removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(whole, F.lit("")).otherwise(F.col("kept"))
    sha = F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "digest"))
    return every.select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept"), sha.alias("kept_sha256"))


def op8_recompression_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
