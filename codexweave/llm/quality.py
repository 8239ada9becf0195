"""Quality classifier (4): gated attention over passages, learned from document labels.

A text is a bag of passages of ``PASSAGE`` words. Each passage is described by shares of character and word kinds and a hashed
bag of its words, and encoded by a dense layer; gated attention weighs the passages, and the
weighted representation gives the score. All weights are learned together from document labels alone, on at most ``TRAIN_ROWS``
labelled documents (those of least hash), whole texts each. Scoring covers every passage of every document.

Null and empty texts are one passage of zeros and get a score like any other; a document with several labels counts
once for each; labels other than 0 and 1 are not learned from; without both labels every score is 0.5; repeated rows
and null ids are scored; an empty table gives no rows; columns beyond key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .words import U, hashes, ragged, slices, split

PASSAGE, BUCKETS, HIDDEN, GATE, TRAIN_ROWS, THRESHOLD = 64, 64, 32, 16, 4000, 0.3
_KINDS = [
    np.array([chr(c).isupper() and c < 128 for c in range(256)]),
    np.array([chr(c).isdigit() and c < 128 for c in range(256)]),
    np.array([c >= 128 for c in range(256)]),
    *[np.array([chr(c) in group for c in range(256)]) for group in ("!", "|", "#$%&*", ".,;:?", "()[]{}<>=\"'/\\@_-+", "\n")],
]
FEATURES = len(_KINDS) + 6 + BUCKETS


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, end to end, and how many each text has (one at least)."""
    w = split(texts)
    h = hashes(w)
    n = np.maximum(-(-w.counts // PASSAGE), 1)
    out = np.zeros((n.sum(), FEATURES), np.float32)
    first = np.cumsum(n) - n
    if len(h):
        text = np.repeat(np.arange(len(n)), w.counts)
        place = np.arange(len(h)) - w.first[:-1][text]
        of = first[text] + place // PASSAGE
        heads = np.flatnonzero(place % PASSAGE == 0)
        rows = of[heads]
        size = np.diff(np.append(heads, len(h))).astype(np.float32)
        begin = w.start[heads]
        length = np.diff(np.append(begin, len(w.data))).astype(np.float32)
        for i, kind in enumerate(_KINDS):
            out[rows, i] = np.add.reduceat(kind[w.data].view(np.uint8), begin, dtype=np.int64) / length
        at = len(_KINDS)
        out[rows, at] = np.add.reduceat(w.end - w.start, heads) / size / 10
        for lag in (1, 2, 4):
            same = np.zeros(len(h), np.int64)
            same[lag:] = (h[lag:] == h[:-lag]) & (of[lag:] == of[:-lag])
            at += 1
            out[rows, at] = np.add.reduceat(same, heads) / size
        out[rows, at + 1] = size / PASSAGE
        out[rows, at + 2] = np.add.reduceat((w.end - w.start <= 3).astype(np.int64), heads) / size
        bag = np.bincount(of * BUCKETS + (h >> U(58)).astype(np.int64), minlength=len(out) * BUCKETS).reshape(len(out), BUCKETS)
        out[:, -BUCKETS:] = np.sqrt(bag / np.maximum(bag.sum(1, keepdims=True), 1))
    return out, n


class Model:
    """Weights, and the forward and backward pass over bags laid end to end."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float64) if k not in "bd" else np.zeros(s) for k, s in shapes.items()}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, x: np.ndarray, n: np.ndarray) -> tuple:
        p, first = self.p, np.cumsum(n) - n
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, first), n))
        a /= np.repeat(np.add.reduceat(a, first), n)
        z = np.add.reduceat(a[:, None] * h, first)
        return x, h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict:
        p, first = self.p, np.cumsum(n) - n
        x, h, t, g, a, z, score = self.forward(x, n)
        out = (score - y) / len(y)
        dz = np.repeat(out, n)[:, None] * p["c"]
        da = (dz * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, first), n))
        gate = ds[:, None] * p["w"]
        dt, dg = gate * g * (1 - t * t), gate * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ out, "d": out.sum(keepdims=True)}

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 6) -> None:
        rng, first, step = np.random.default_rng(seed), np.cumsum(n) - n, 0
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(n))
            for at in range(0, len(n), batch):
                bags = order[at : at + batch]
                rows = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in bags])
                step += 1
                for k, g in self.gradients(x[rows], n[bags], y[bags]).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model | None:
    """Fit on the documents of ``labels`` (key, quality) that are not held out, ``TRAIN_ROWS`` at most; None without both labels."""
    known = labels.filter(~held_out(F.col(key)) & F.col("quality").isin(0, 1)).select(F.col(key).alias("_id"), F.col("quality").alias("_y"))
    some = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(TRAIN_ROWS)
    rows = lean(docs).select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(some), F.col("_key") == F.col("_id")).select("text", F.col("_y").cast("double").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, n = passages(batch["text"])
            yield pa.record_batch([batch["y"], ragged(x.reshape(-1), n * FEATURES, pa.float32())], names=["y", "x"])

    got = rows.mapInArrow(run, "y double, x array<float>").toArrow()
    y = got["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    lists = got["x"].combine_chunks()
    model = Model()
    model.fit(lists.flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64), lists.value_lengths().to_numpy() // FEATURES, y)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, n = passages(batch["text"])
            found = model.forward(x, n)[-1] if model else np.full(len(n), 0.5)
            yield pa.record_batch([batch["doc_id"], batch["held_out"], pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = lean(docs).select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The documents, all columns as they are, that the model doesn't reject."""
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for part in slices(iter([pa.record_batch([batch.column(at)], names=["text"])])):
                keep.append(model.forward(*passages(part["text"]))[-1] >= THRESHOLD if model else np.ones(len(part), bool))
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep])))

    return lean(docs).mapInArrow(run, schema)


def op4_attention_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
