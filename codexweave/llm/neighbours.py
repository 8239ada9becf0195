"""Approximate nearest neighbours (1): additive quantisation with beam search, table lookups, exact reranking.

A vector is its norm, stored, times a direction, which is the sum of ``BOOKS`` codewords of full dimension. The codebooks are fitted
to what the earlier ones leave, on at most ``FIT_ROWS`` rows (the rows of least hash), and refitted to codes from a beam
search of ``BEAM`` paths; every row is encoded by such a search. A query's inner products with all codewords
make a table; a row's score is the sum of its codes' entries times its norm. Rows and queries meet in blocks: each
pair of blocks keeps every query's ``SHORT`` best rows by that score, ranks them by the exact inner product in double
precision, and passes on the ``k`` best.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part; of ties the smaller vec_id comes
first; repeated rows are candidates each (those of the query's own id never are); of query rows with one id, that with the least hash of its vector asks; with no rows left the result is empty; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, partitions

BOOKS, WORDS, BEAM, FIT_ROWS, SHORT = 8, 256, 4, 20_000, 200
BLOCK, QUERIES = 4096, 512


@contextmanager
def arrow_rows(spark, n: int):
    """At most n rows in an Arrow batch, for rows that hold whole blocks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows by codebooks) of the sums nearest to x that a beam search finds."""
    n, words = len(x), books.shape[1]
    left, codes, error = x[:, None, :], np.zeros((n, 1, 0), np.uint8), np.zeros((n, 1), x.dtype)
    for book in books:
        cost = (left * left).sum(-1)[..., None] - 2 * (left.reshape(-1, x.shape[1]) @ book.T).reshape(n, -1, words) + (book * book).sum(1)
        cost = cost.reshape(n, -1)
        keep = min(beam, cost.shape[1])
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
        path, word = best // words, best % words
        row = np.arange(n)[:, None]
        left = left[row, path] - book[word]
        codes = np.concatenate([codes[row, path], word[..., None].astype(np.uint8)], axis=2)
        error = cost[row, best]
    return codes[np.arange(n), error.argmin(1)]


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, turns: int = 4, seed: int = 3) -> np.ndarray:
    """Full-dimensional residual codebooks for the rows of x (directions)."""
    rng = np.random.default_rng(seed)
    words = min(words, len(x))
    out, left = np.zeros((books, words, x.shape[1]), np.float32), x.copy()

    def means(rows: np.ndarray, code: np.ndarray, old: np.ndarray) -> np.ndarray:
        order = np.argsort(code, kind="stable")
        n = np.bincount(code, minlength=words)
        total = np.zeros_like(old)
        full = n > 0
        total[full] = np.add.reduceat(rows[order], (np.cumsum(n) - n)[full])
        return np.where(full[:, None], total / np.maximum(n, 1)[:, None], old)

    for m in range(books):
        book = left[rng.choice(len(left), words, replace=False)]
        for _ in range(turns):
            code = (-2 * left @ book.T + (book * book).sum(1)).argmin(1)
            book = means(left, code, book)
        out[m] = book
        left = left - book[(-2 * left @ book.T + (book * book).sum(1)).argmin(1)]
    for _ in range(2):
        codes = encode(x, out)
        for m in range(books):
            rest = x - sum(out[j][codes[:, j]] for j in range(books) if j != m)
            out[m] = means(rest, codes[:, m], out[m])
    return out


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _blocks(df: DataFrame, size: int, books=None) -> DataFrame:
    """Rows (vec_id, vector) as blocks: block, ids, vectors and, with codebooks, codes and norms, all as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = _matrix(part["vector"])
                codes = norms = b""
                if books is not None:
                    norm = np.sqrt((x * x).sum(1))
                    codes = encode((x / norm[:, None]).astype(np.float32), books.value).tobytes()
                    norms = norm.astype(np.float32).tobytes()
                ids = part["vec_id"].to_numpy().astype(np.int64).tobytes()
                key = uuid.uuid5(uuid.NAMESPACE_OID, ids.hex()).hex
                yield pa.record_batch([[key], [ids], [x.tobytes()], [codes], [norms]], names=["block", "ids", "vectors", "codes", "norms"])

    return df.mapInArrow(run, "block string, ids binary, vectors binary, codes binary, norms binary")


def _meet(k: int, books) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                x, q = np.frombuffer(r["vectors"]).reshape(len(ids), -1), np.frombuffer(r["q_vectors"]).reshape(len(q_ids), -1)
                codes, norms = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(r["norms"], np.float32)
                tables = np.einsum("qd,mwd->mwq", q.astype(np.float32), books.value)
                rough = np.zeros((len(ids), len(q_ids)), np.float32)
                for m in range(codes.shape[1]):
                    rough += tables[m][codes[:, m]]
                rough *= norms[:, None]
                rough[ids[:, None] == q_ids[None, :]] = -np.inf
                short = min(SHORT, len(ids))
                best = np.argpartition(-rough, short - 1, axis=0)[:short].T
                exact = np.einsum("qsd,qd->qs", x[best], q)
                exact[ids[best] == q_ids[:, None]] = -np.inf
                order = np.lexsort((ids[best], -exact), axis=1)[:, :k]
                row = np.arange(len(q_ids))[:, None]
                score, found = exact[row, order], ids[best][row, order]
                real = np.isfinite(score)
                yield pa.record_batch([np.repeat(q_ids, real.sum(1)), found[real], score[real]], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries`` the k best of ``vectors`` (both vec_id, vector: arrays of numbers)."""
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())

    good = clean(vectors)
    lengths = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dimension = lengths[0]["n"] if lengths else 1
    good, asked = good.filter(F.size("vector") == dimension), clean(queries).filter(F.size("vector") == dimension)
    asked = asked.groupBy("vec_id").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))
    sample = good.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(FIT_ROWS).select("vector").toArrow()["vector"].combine_chunks()
    x = _matrix(sample) if len(sample) else np.ones((1, dimension))
    books = spark.sparkContext.broadcast(fit((x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)))
    shards = partitions(spark)
    with arrow_rows(spark, BLOCK):
        index = cut(_blocks(good, BLOCK, books).withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards))))
        blocks = cut(_blocks(asked, QUERIES).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    used = index.select("shard").distinct()
    spread = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>"))).join(used, "shard", "left_semi")
    pairs = index.join(spread, "shard").select("ids", "vectors", "codes", "norms", "q_ids", "q_vectors")
    with arrow_rows(spark, 4):
        found = cut(pairs.mapInArrow(_meet(k, books), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_additive_quantisation(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    return search(rows, rows.filter("vec_id % 20 = 0"))
