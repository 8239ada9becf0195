"""Token-ID output (9): Arrow files of fixed-size lists, read back without copying.

Documents are range-sorted by ``doc_id``; each range becomes one Arrow IPC file whose batches hold
``length`` ids per row (``ids``: uint16 where the vocabulary fits, else uint32), with two lists of
bits of the same length: ``mask`` (false on the padding of a file's last row) and ``starts`` (true on each
document's first id). Row r of a batch begins at byte r * length * width of its buffer, so
a memory-mapped file gives any sequence without parsing. A second file beside it lists the ranges'
documents. A file is written under a name of its own attempt and then renamed: a
repeated task leaves the same bytes under the same name.

Nulls and empty texts give the end id alone; a null doc_id sorts first; repeated rows are kept, in order of
their texts' hashes; further columns don't matter; an empty table gives files without rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import before, cut, folder, lean, partitions
from .tokens import encoder, with_end
from .words import slices

ROWS = 256


def _schema(length: int, wide: bool) -> pa.Schema:
    bits = pa.list_(pa.bool_(), length)
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", bits), ("starts", bits)])


class _Rows:
    """Gathers ids and writes them as rows of ``length``, in batches of ``ROWS``; holds one batch and one text slice."""

    def __init__(self, sink, schema: pa.Schema, length: int):
        self.writer, self.schema, self.length, self.left = pa.ipc.new_file(sink, schema), schema, length, []
        self.kind = schema.field("ids").type.value_type.to_pandas_dtype()

    def add(self, ids: np.ndarray, starts: np.ndarray) -> None:
        self.left.append((ids.astype(self.kind), starts))
        if sum(len(x) for x, _ in self.left) >= ROWS * self.length:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        ids, starts = (np.concatenate(x) for x in zip(*self.left)) if self.left else (np.zeros(0, self.kind), np.zeros(0, bool))
        mask = np.ones(len(ids), bool)
        if last and (lack := -len(ids) % self.length):
            ids, starts, mask = (np.append(x, np.zeros(lack, x.dtype)) for x in (ids, starts, mask))
        step = ROWS * self.length
        whole = len(ids) if last else len(ids) // step * step
        for at in range(0, whole, step):
            part = slice(at, min(at + step, whole))
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x[part]), self.length) for x in (ids, mask, starts)], schema=self.schema))
        self.left = [(ids[whole:], starts[whole:])]

    def close(self) -> None:
        self._write(last=True)
        self.writer.close()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, length: int = 2048, spaced: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write all documents' ids in ascending ``key`` under ``path``; the manifest: file, part, n_tokens."""
    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) > 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"{root}/{kind}-{part:06d}.arrow" for kind in ("sequences", "documents")]
        listed = pa.schema([("doc_id", pa.int64())])
        with store.open_output_stream(f"{names[0]}.{attempt}") as a, store.open_output_stream(f"{names[1]}.{attempt}") as b:
            rows, documents, total = _Rows(a, _schema(length, wide), length), pa.ipc.new_file(b, listed), 0
            for batch in slices(batches, limit=2 << 20):
                ids, counts = with_end(*encoder(tokenizer, spaced).encode(batch["text"]), end_id)
                starts = np.zeros(len(ids), bool)
                starts[np.cumsum(counts) - counts] = True
                rows.add(ids, starts)
                documents.write_batch(pa.record_batch([batch["doc_id"]], schema=listed))
                total += len(ids)
            rows.close()
            documents.close()
        for name in names:
            store.move(f"{name}.{attempt}", name)
        yield pa.record_batch([pa.array([f"{part:06d}"]), pa.array([part], pa.int64()), pa.array([total], pa.int64())], names=["file", "part", "n_tokens"])

    rows = lean(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return cut(dealt.mapInArrow(run, "file string, part long, n_tokens long"))


def sequences(path: str, file: str):
    """One file's reader: ``get_batch(i)`` maps batch i; nothing is copied on local disks."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    name = f"{root}/sequences-{file}.arrow"
    return pa.ipc.open_file(pa.memory_map(name) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(name))


def read(manifest: DataFrame, path: str) -> DataFrame:
    """Documents as the files have them: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist()):
                with store.open_input_file(f"{root}/documents-{file}.arrow") as f:
                    documents = pa.ipc.open_file(f).read_all()["doc_id"].combine_chunks()
                counts, crcs, reader = [], [], sequences(path, file)
                for i in range(reader.num_record_batches):
                    x = reader.get_batch(i)
                    ids, mask, starts = (x[c].flatten().to_numpy(zero_copy_only=False) for c in ("ids", "mask", "starts"))
                    ids, at = ids[mask].astype("<u4"), np.flatnonzero(starts[mask])
                    edges = np.unique(np.concatenate([[0], at, [len(ids)]]))
                    fresh = set(at.tolist())
                    for a, b in zip(edges.tolist(), edges[1:].tolist()):
                        if a in fresh:
                            counts.append(0)
                            crcs.append(0)
                        counts[-1] += b - a
                        crcs[-1] = zlib.crc32(ids[a:b], crcs[-1])
                n = np.array(counts, np.int64)
                yield pa.record_batch([documents, pa.array(base + np.cumsum(n) - n, pa.int64()), pa.array(n), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = before(manifest, "part", "n_tokens", "base").repartition(partitions(manifest.sparkSession), "file")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_arrow_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = folder(spark)
    manifest = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read(manifest, path)
