"""Token-id output: flat unsigned integer files with 64-bit document offsets.

One pair of files per partition of ascending document ids:

* ``part-NNNNN.bin``: the ids of its documents one after the other, as
  little-endian unsigned integers of 2 bytes where the vocabulary allows, else 4;
* ``part-NNNNN.idx``: little-endian int64 values: number of documents n, n + 1
  offsets (in ids) into the ``.bin`` file, n document ids, n flags (1: the id
  is not null).

The manifest has one row per partition; its bases, the number of ids and of
documents in earlier partitions, are prefix sums over those rows, so any
document's global start is base plus local offset. Readers map the files.

A task writes under a name of its own and renames at the end. Contents depend
only on the input rows, so a repeated task leaves the same files. Paths go
through ``pyarrow.fs``: any shared folder Arrow knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.bpe import encode_texts, encoder
from wordloom.llm.common import in_arrow, written
from wordloom.llm.words import texts_of

MANIFEST = "part int, bin string, idx string, width int, n_docs bigint, n_tokens bigint"
READ_DOCS = 2000   # documents per batch when reading back


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def token_width(tokenizer_file: str, end_id: int) -> int:
    """Bytes per id: 2 if every id of the vocabulary and ``end_id`` fit."""
    size = encoder(tokenizer_file).tokenizer.get_vocab_size(with_added_tokens=True)
    return 2 if max(size - 1, end_id) < 1 << 16 else 4


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by ``end_id``."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files under ``folder`` and returns the manifest, one row
    per partition. Rows are range-partitioned by id and sorted (repeated ids
    by text); null ids come first, null texts count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        width = token_width(tokenizer_file, end_id)
        own, ids, sizes = uuid.uuid4().hex, [], []
        name = f"{root}/part-{part:05d}"
        n_tokens = 0
        with fs.open_output_stream(f"{name}.bin.{own}") as out:
            for b in batches:
                tokens, offsets = with_end(*encode_texts(tokenizer_file, texts_of(b.column(1))), end_id)
                out.write(tokens.astype(f"<u{width}").tobytes())
                ids.append(b.column(0))
                sizes.append(np.diff(offsets))
                n_tokens += len(tokens)
        n_docs = sum(map(len, ids))
        if n_docs == 0:
            fs.delete_file(f"{name}.bin.{own}")
            return
        col = pa.chunked_array(ids).cast(pa.int64())
        lengths = np.concatenate(sizes)
        with fs.open_output_stream(f"{name}.idx.{own}") as out:
            for a in ([n_docs], [0], np.cumsum(lengths), col.fill_null(0).to_numpy(),
                      col.is_valid().to_numpy()):
                out.write(np.asarray(a).astype("<i8").tobytes())
        for kind in ("bin", "idx"):
            fs.move(f"{name}.{kind}.{own}", f"{name}.{kind}")
        uri = f"{folder}/part-{part:05d}"
        yield pa.RecordBatch.from_pylist([{"part": part, "bin": f"{uri}.bin", "idx": f"{uri}.idx", "width": width,
                                           "n_docs": n_docs, "n_tokens": n_tokens}],
                                         schema=pa.schema([("part", pa.int32()), ("bin", pa.string()),
                                                           ("idx", pa.string()), ("width", pa.int32()),
                                                           ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")) \
        .repartitionByRange("id").sortWithinPartitions("id", "text")
    return written(docs.sparkSession, in_arrow(ordered, run, MANIFEST), "token-manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """Adds ``base`` (ids in earlier partitions) and ``doc_base``. The window
    spans the manifest: one row per file, not per document."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumns({
        "base": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)),
        "doc_base": F.coalesce(F.sum("n_docs").over(before), F.lit(0)),
    })


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped on a mounted folder, else fetched."""
    fs, path = file_system(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


def read_documents(bin_uri: str, idx_uri: str, width: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """``(document id, local start, ids)`` for each document of a file."""
    idx = _mapped(idx_uri, "<i8")
    ids = _mapped(bin_uri, f"<u{width}")
    n = int(idx[0])
    offsets, doc, valid = idx[1:n + 2], idx[n + 2:2 * n + 2], idx[2 * n + 2:3 * n + 2]
    for i in range(n):
        yield int(doc[i]) if valid[i] else None, int(offsets[i]), ids[offsets[i]:offsets[i + 1]]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document, read from the files: id, ``start`` (ids of all
    earlier documents), ``n_tokens``, ``ids_crc32`` (of the ids as
    little-endian 32-bit integers)."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.to_pylist():
                rows = []
                for doc, start, ids in read_documents(m["bin"], m["idx"], m["width"]):
                    rows.append((doc, m["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == READ_DOCS:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    files = with_bases(manifest)
    spread = files.repartition(max(1, manifest.count()))
    return in_arrow(spread, run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint") \
        .withColumnRenamed("id", id_col)
