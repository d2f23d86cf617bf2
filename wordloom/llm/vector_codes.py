"""Product quantisation of vectors, nearest entries found by intersected bitmasks.

Components become integers, a vector is cut into :data:`PARTS` equal
consecutive parts, and every part position has a codebook of up to 64 entries.
A vector's code is the index of the nearest entry in each part (squared
Euclidean distance, ties to the lower index).

**Nearest entry by slices.** Per part and dimension the entries' coordinates
are sorted, and prefix ``k`` of the sorted list carries a 64-bit mask of the
entries in it. For a value ``x`` and a radius ``r`` two binary searches give
the entries with a coordinate in ``[x - r, x + r]``: ``prefix[hi] ^
prefix[lo]``. The masks of all dimensions ANDed leave the entries inside the
box. The initial radius is the distance to an entry that lies next to ``x`` in
one dimension (the best of these), rounded up, so the box holds that entry and
every entry at most as far: the candidates contain the nearest one and all its
ties, and only their distances are computed.

**Learning.** The codebook starts as the parts of the 64 smallest ids. A round
assigns every part and replaces each entry by its parts' componentwise
``floor(sum / count)``; unused entries stay. Tasks send on sums and counts per
(part, entry), at most 1,024 rows a task; the codebook itself, 64 entries of
the vector's length, is the only model and the only thing collected or
broadcast.

Defined results: rows whose vector is null or holds a null or non-finite
component are dropped. Rows that repeat an id are ordered by their components,
rows with a null id come after all others. Fewer than 64 rows give as many
entries. Kept vectors whose lengths differ from each other or are no
multiple of :data:`PARTS`, or with a component beyond +-:data:`LARGEST` after
scaling (squares would not fit), raise. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import Batches, in_arrow, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 26
#: labels whose error sums are joined by broadcast; more are joined by a salted shuffle
MAX_BROADCAST_LABELS = 100_000
SALTS = 32

ONE = np.uint64(1)


def _values(col: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of scaled integers."""
    lengths = np.diff(np.asarray(col.offsets))
    if (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    x = np.floor(np.asarray(col.flatten(), dtype=np.float64) * SCALE).reshape(len(col), -1)
    if x.shape[1] == 0 or x.shape[1] % PARTS:
        raise ValueError(f"the length of a vector, {x.shape[1]}, is no multiple of {PARTS}")
    if (np.abs(x) > LARGEST).any():
        raise ValueError(f"a component is beyond {LARGEST // SCALE}")
    return x.astype(np.int64)


def kept_rows(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, label, vec array<double>)`` of the rows with a whole, finite vector."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                          F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull() & finite)


@dataclass
class PartIndex:
    """The entries of one part, ``(entries, dimensions)``, with their sorted
    coordinates and prefix masks per dimension."""
    entries: np.ndarray

    def __post_init__(self):
        n, dims = self.entries.shape
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.entries, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T)
        bits = ONE << self.order.astype(np.uint64)
        self.prefix = np.concatenate([np.zeros((dims, 1), np.uint64), np.bitwise_or.accumulate(bits, axis=1)], axis=1)

    def distances(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        d = x - self.entries[entry]
        return np.einsum("ij,ij->i", d, d)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """For each row the distance, rounded up, to the closest of the
        entries next to it in one dimension."""
        best = None
        for d in range(x.shape[1]):
            at = np.searchsorted(self.sorted[d], x[:, d])
            for place in (np.maximum(at - 1, 0), np.minimum(at, len(self.entries) - 1)):
                dist = self.distances(x, self.order[d][place])
                best = dist if best is None else np.minimum(best, dist)
        r = np.ceil(np.sqrt(best.astype(np.float64))).astype(np.int64)
        return r + (r * r < best)      # the root of a large square may be rounded down

    def candidates(self, x: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Masks of the entries within ``r`` of ``x`` in every dimension."""
        masks = np.full(len(x), ~np.uint64(0))
        for d in range(x.shape[1]):
            lo = np.searchsorted(self.sorted[d], x[:, d] - r, side="left")
            hi = np.searchsorted(self.sorted[d], x[:, d] + r, side="right")
            masks &= self.prefix[d][hi] ^ self.prefix[d][lo]
        return masks

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of each row."""
        masks = self.candidates(x, self.radius(x))
        best = np.full(len(x), np.iinfo(np.int64).max)
        entry = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while len(rows):
            m = masks[rows]
            low = m & (~m + ONE)                        # the lowest entry not yet measured
            e = np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1
            dist = self.distances(x[rows], e)
            nearer = dist < best[rows]
            best[rows[nearer]], entry[rows[nearer]] = dist[nearer], e[nearer]
            masks[rows] = m ^ low
            rows = rows[masks[rows] != 0]
        return entry, best


@dataclass
class Codebooks:
    """``entries`` is ``(parts, entries, dimensions of a part)`` of integers."""
    entries: np.ndarray

    def text(self) -> str:
        """All components by part, entry and place within the part."""
        return ",".join(map(str, self.entries.ravel().tolist()))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every part of the rows of ``x``."""
        parts = x.reshape(len(x), self.entries.shape[0], -1)
        if parts.shape[2] != self.entries.shape[2]:
            raise ValueError("vectors differ in length")
        got = [PartIndex(e).nearest(np.ascontiguousarray(parts[:, p])) for p, e in enumerate(self.entries)]
        return np.stack([e for e, _ in got], axis=1), np.stack([d for _, d in got], axis=1)


def first_codebooks(rows: DataFrame, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the smallest ids; ``None`` for an empty table."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    if not first:
        return None
    x = _values(pa.array([r["vec"] for r in first], pa.list_(pa.float64())))
    return Codebooks(np.ascontiguousarray(x.reshape(len(x), PARTS, -1).transpose(1, 0, 2)))


def improved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round over all rows."""
    held = rows.sparkSession.sparkContext.broadcast(books)
    _, n_entries, dims = books.entries.shape

    def sums(batches: Batches) -> Batches:
        total = np.zeros((PARTS * n_entries, dims + 1), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _values(b.column(0))
            code, _ = held.value.assign(x)
            place = (code + np.arange(PARTS) * n_entries).ravel()
            total[:, 0] += np.bincount(place, minlength=len(total))
            np.add.at(total[:, 1:], place, x.reshape(-1, dims))
        used = np.flatnonzero(total[:, 0])
        out = [pa.array(used), pa.array(total[used, 0]),
               pa.array(total[used, 1:].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, ["place", "n", "s"])

    partial = in_arrow(rows.select("vec"), sums, "place bigint, n bigint, s array<bigint>")
    added = partial.groupBy("place").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(dims)])
    new = books.entries.reshape(-1, dims).copy()
    for r in added.collect():       # at most one row an entry
        new[r["place"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
    held.unpersist()
    return Codebooks(new.reshape(books.entries.shape))


def fit(rows: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    books = first_codebooks(rows)
    for _ in range(rounds if books else 0):
        books = improved(rows, books)
    return books


CODED = "id {id}, label {label}, code string, error bigint"


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``(id, label, code, error)``: two hex digits a part, and the squared
    distances summed over the parts."""
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            code, dist = held.value.assign(_values(b.column(2)))
            hexed = code.astype(np.uint8).tobytes().hex()
            width = 2 * code.shape[1]
            codes = [hexed[i:i + width] for i in range(0, len(hexed), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes), pa.array(dist.sum(axis=1))],
                                             ["id", "label", "code", "error"])

    types = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return in_arrow(rows.select("id", "label", "vec"), run, CODED.format(**types))


def with_label_error(coded: DataFrame, most: int = MAX_BROADCAST_LABELS) -> DataFrame:
    """``coded`` with ``label_error``, the errors of its label added up (nulls
    are one label). Up to ``most`` labels the sums are broadcast; more are
    joined on (label, salt), so that a label with a large share of the rows is
    no single task's."""
    spark = coded.sparkSession
    sums = written(spark, coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "_label")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= most:
        return coded.join(F.broadcast(sums), same).drop("_label")
    salted = coded.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS).cast("bigint")))
    spread = sums.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(spread, same & (F.col("_salt") == F.col("_part"))).drop("_label", "_salt", "_part")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """``(id, label, code, error, label_error)`` of every kept row, and the codebooks."""
    spark = vectors.sparkSession
    rows = kept_rows(vectors, id_col, vec_col, label_col)
    books = fit(rows, rounds)
    if books is None:
        schema = CODED.format(**{c: rows.schema[c].dataType.simpleString() for c in ("id", "label")})
        return spark.createDataFrame([], f"{schema}, label_error bigint"), None
    return with_label_error(written(spark, encode(rows, books), "codes")), books


def decode(codes: list[str], books: Codebooks) -> np.ndarray:
    """The scaled integer vectors that codes stand for."""
    index = np.array([list(bytes.fromhex(c)) for c in codes], dtype=np.int64).reshape(len(codes), PARTS)
    return books.entries[np.arange(PARTS), index].reshape(len(codes), -1)
