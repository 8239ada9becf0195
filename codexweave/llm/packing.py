"""Best-fit packing (2): bulk-synchronous rounds over range-sorted documents and gaps.

Lengths and gaps are integers up to ``capacity``, so the sorted order of either is that of at most
``capacity`` classes, and a document is known by its class and its rank there. Spark counts the classes,
ranks the documents (each class dealt over salts, so one frequent length is no hot spot) and places
them; what the rounds exchange is the classes' counts, bounded by ``capacity`` whatever the input.
A round sweeps the lengths downwards: each class goes to the successor of its length among the
gaps that were open when the round began, ranks decide who gets which gap, the rest go on to the next
larger gap; then gaps are updated and the next round begins. When no gap takes anything, as many new
sequences are opened as the rest needs at least.

Pieces of equal length are ordered by doc_id, piece and checksum; repeated rows each get a place; an empty table gives
no rows; a null text is an empty document, which has its end id.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import cut, lean, partitions
from .tokens import encoder, with_end
from .words import binaries, slices


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, spaced: bool = False, with_ids: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents as token pieces of at most ``capacity``: doc_id, piece, start, length, ids_crc32 and, if asked, ids (little-endian uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            ids, counts = with_end(*encoder(tokenizer, spaced).encode(batch["text"]), end_id)
            ids = ids.astype("<u4")
            n = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(counts[row] - start, capacity)
            at = (np.cumsum(counts) - counts)[row] + start
            crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(at.tolist(), length.tolist())]
            columns = [batch["doc_id"].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, binaries(ids, length)], [*names, "ids"]
            yield pa.record_batch(columns, names=names)

    rows = lean(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class _Gaps:
    """Open sequences by gap: runs of consecutive numbers, each with the place where its gap begins."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def add(self, gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in self.runs:
                self.runs[gap] = []
                bisect.insort(self.sizes, gap)
            self.runs[gap].append((first, n))

    def successor(self, length: int) -> int | None:
        at = bisect.bisect_left(self.sizes, length)
        return self.sizes[at] if at < len(self.sizes) else None

    def take(self, gap: int, most: int) -> tuple[int, int]:
        first, n = self.runs[gap].pop()
        if n > most:
            self.runs[gap].append((first + most, n - most))
        if not self.runs[gap]:
            del self.runs[gap]
            self.sizes.remove(gap)
        return first, min(n, most)


def rounds(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Placements of whole classes: rows of length, first rank, documents, first sequence, documents to a sequence, offset.

    ``counts`` has at most ``capacity`` entries; a step takes up a class or a run of gaps, so their number
    follows ``capacity`` and the rounds, not the documents.
    """
    left, rank, out, gaps, opened = dict(counts), dict.fromkeys(counts, 0), [], _Gaps(), 0
    while left:
        updated, moved = [], False
        for length in sorted(left, reverse=True):
            while length in left and (gap := gaps.successor(length)) is not None:
                each, n = gap // length, left[length]
                first, taken = gaps.take(gap, -(-n // each))
                placed = min(n, taken * each)
                out.append((length, rank[length], placed, first, each, capacity - gap))
                full, rest = divmod(placed, each)
                updated += [(gap - each * length, first, full), (gap - rest * length, first + full, 1 if rest else 0)]
                rank[length] += placed
                left[length] -= placed
                moved = True
                if not left[length]:
                    del left[length]
        for x in updated:
            gaps.add(*x)
        if left and not moved:
            new = -(-sum(k * n for k, n in left.items()) // capacity)
            gaps.add(capacity, opened, new)
            opened += new
    return np.array(out, np.int64).reshape(-1, 6)


def pack(items: DataFrame, capacity: int, salts: int | None = None) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece, length (1 to ``capacity``) and ids_crc32."""
    spark = items.sparkSession
    salts = salts or partitions(spark)
    class_salt = ["length", "_salt"]
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counted = salted.groupBy(*class_salt).agg(F.count("*").alias("_n"))
    lower = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counted = cut(counted.withColumn("_base", F.coalesce(F.sum("_n").over(lower), F.lit(0))))
    table = rounds({r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, capacity)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(table)
    fields = items.schema.fields
    schema = StructType([*fields]).add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = (t[:, 0] << 44) + t[:, 1]
        for batch in batches:
            length, rank = (batch[c].to_numpy() for c in ("length", "_rank"))
            hit = t[np.searchsorted(keys, (length.astype(np.int64) << 44) + rank, side="right") - 1]
            k = rank - hit[:, 1]
            columns = [batch[f.name] for f in fields]
            yield pa.record_batch([*columns, pa.array(hit[:, 3] + k // hit[:, 4]), pa.array(hit[:, 5] + k % hit[:, 4] * length)], names=schema.names)

    inside = Window.partitionBy(*class_salt).orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_in", F.row_number().over(inside)).join(counted.drop("_n").hint("merge"), class_salt)
    ranked = ranked.select(*items.columns, (F.col("_base") + F.col("_in") - 1).alias("_rank"))
    return ranked.mapInArrow(place, schema)


def best_fit(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer, end_id, capacity, with_ids=with_ids)), capacity)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
