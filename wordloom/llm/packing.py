"""Sum-of-squares online packing of documents into fixed-length sequences.

A document's ids are cut into whole windows of the capacity, each a sequence
of its own, and one remainder. Remainders are packed online: a packer keeps,
per fill level, the stack of open windows at that level, and puts each
remainder where the sum of squared counts of partially filled windows becomes
least (a window that becomes full counts no more). Ties go to the fullest
level, then to the window opened last.

Remainders are dealt to packers by a hash, so a packer's work and its level
array are bounded (:data:`ITEMS_PER_PACKER` expected remainders, capacity
levels) however large the input or its largest source. What lies in windows
that are not full at the end goes through another round of the same rule,
longest first.

Sequence ids are dense: prefix sums over the groups that made sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.bpe import encode_texts
from wordloom.llm.common import in_arrow, remove, written
from wordloom.llm.token_files import with_end
from wordloom.llm.words import texts_of

CAPACITY = 2048
ITEMS_PER_PACKER = 8_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Places sizes (below the capacity) in order; returns each one's window
    and offset, and the windows still partially filled."""
    count = np.zeros(capacity + 1, dtype=np.int64)   # open windows per level
    stack: list[list[int]] = [[] for _ in range(capacity + 1)]
    window = np.empty(len(sizes), dtype=np.int64)
    offset = np.empty(len(sizes), dtype=np.int64)
    opened = 0
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        # the change of the sum of squares for a window at level h, h + s < capacity:
        # (c[h] - 1)^2 + (c[h + s] + 1)^2 - c[h]^2 - c[h + s]^2
        levels = capacity - s
        here = count[:levels + 1]
        change = 2 * (count[s:] - here) + 2
        change[here == 0] = far
        change[0] = 2 * count[s] + 1            # a new window
        if count[levels]:
            change[levels] = 1 - 2 * count[levels]   # becomes full
        h = levels - int(change[::-1].argmin())
        if h == 0:
            w = opened
            opened += 1
        else:
            w = stack[h].pop()
            count[h] -= 1
        window[i], offset[i] = w, h
        if h + s < capacity:
            stack[h + s].append(w)
            count[h + s] += 1
    return window, offset, [w for level in stack for w in level]


def place_again(sizes: np.ndarray, window: np.ndarray, offset: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Empties the windows that are not full and sends what they held through
    another round of the same rule, longest first; windows are numbered
    densely again."""
    window, offset = window.copy(), offset.copy()
    fill = np.bincount(window, sizes)
    again = np.flatnonzero(fill[window] < capacity)
    again = again[np.argsort(-sizes[again], kind="stable")]
    placed, offset[again], _ = sum_of_squares(sizes[again], capacity)
    window[again] = len(fill) + placed
    return np.unique(window, return_inverse=True)[1].reshape(-1), offset


PIECES = "doc bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, grp bigint, seq bigint, salt bigint"


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int,
           id_col: str, text_col: str) -> DataFrame:
    """Documents cut into whole windows and a remainder, with a checksum of
    each piece. Whole windows are numbered within their partition (``grp`` is
    -1 - partition, ``seq`` the number); remainders have null ``seq``. ``salt``
    tells equal pieces apart: it is written with them, by partition and row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, full, rows = -1 - TaskContext.get().partitionId(), 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, offsets = with_end(*encode_texts(tokenizer_file, texts_of(b.column(1))), end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            size = np.diff(offsets)
            n_pieces = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n_pieces)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = at * capacity
            length = np.minimum(capacity, size[doc] - start)
            begin = offsets[doc] + start
            crc = [zlib.crc32(raw[4 * x:4 * (x + n)]) for x, n in zip(begin.tolist(), length.tolist())]
            whole = length == capacity
            seq = full + np.cumsum(whole) - 1
            full += int(whole.sum())
            salt = (-1 - group << 40) + rows + np.arange(len(doc))
            rows += len(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                 pa.array(size[doc]), pa.array(np.full(len(doc), group)), pa.array(seq, mask=~whole),
                 pa.array(salt)],
                ["doc", "start", "length", "ids_crc32", "doc_tokens", "grp", "seq", "salt"])
    return in_arrow(docs.select(F.col(id_col).cast("bigint"), text_col), run, PIECES)


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = CAPACITY,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, ``start`` and ``length`` in its document,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset`` there.

    Null texts are empty: one piece holding the end id. Repeated rows are
    packed as often as they occur; null ids stay null.
    """
    spark = docs.sparkSession
    cut = written(spark, pieces(docs, tokenizer_file, end_id, capacity, id_col, text_col), "pieces")
    whole, rest = cut.filter("seq is not null"), cut.filter("seq is null")
    n_packers = max(1, -(-rest.count() // ITEMS_PER_PACKER))

    def packer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "salt"], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        window, offset = place_again(sizes, *sum_of_squares(sizes, capacity)[:2], capacity)
        return pdf.assign(seq=window, offset=offset).drop(columns=["order"])

    # by the salt too, or a row that repeats would fill one packer
    order = F.xxhash64("doc", "start", "ids_crc32", "salt")
    dealt = rest.withColumn("order", order) \
        .withColumn("grp", F.pmod(F.col("order"), F.lit(n_packers)).cast("bigint"))
    packed = dealt.groupBy("grp").applyInPandas(packer, f"{PIECES}, offset bigint")
    placed = written(spark, packed.unionByName(whole.withColumn("offset", F.lit(0).cast("bigint"))), "packed")
    # rows: one per packer and per input partition
    groups = placed.groupBy("grp").agg((F.max("seq") + 1).alias("n"))
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(spark, groups.select("grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    remove(spark, cut)
    return placed.join(bases, "grp").select(
        F.col("doc").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("seq")).alias("sequence_id"), "offset")
