"""Exact nearest vectors for a table of queries, pruned by pivots.

Vectors are compared by cosine, that is by the angle between them, and angles
obey the triangle inequality. A few pivots are chosen from a bounded sample
(the choice decides what can be skipped, never what is found); every vector is
stored with its nearest pivot, its block, and its angle to it. A block keeps
the least and greatest of these angles, so a query at angle ``a`` to the pivot
is at least ``max(a - greatest, least - a)`` from all vectors of the block.

Queries are a distributed table like the vectors. Each first meets its own
block, whose k-th best similarity bounds the answer; then it visits only the
blocks whose least angle does not exceed that bound. Both steps are one join
of visits and vectors by cell: a block is split into cells of about
:data:`CELL_VECTORS` vectors by a hash, and visits into groups of about
:data:`CELL_QUERIES` queries, so a task's matrix is bounded however many equal
vectors a block holds and however many queries visit it. A cell sends k rows a
query; the driver sees the pivots and one row of figures a block.

Zero vectors have no angle: they are a block of their own, visited only where
fewer than k others exist, and a zero query takes the smallest ids. Ties go to
the smaller id; similarities are compared after rounding to 13 digits, so that
equal vectors tie wherever they are computed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import ship_package, written

PIVOTS = 64
SAMPLE = 4_096          # vectors from which the pivots are chosen
CELL_VECTORS = 20_000
CELL_QUERIES = 2_000
TILE = 512              # queries of a matrix that are compared at once
ZERO_BLOCK = -1
SLACK = 1e-7            # angles of rounded unit vectors are off by less
DIGITS = 13


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix; differing lengths raise."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    lengths = np.diff(np.asarray(col.offsets))
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), lengths[0] if len(lengths) else 0)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows divided by their norm; NaN for a zero row."""
    n = np.sqrt((m * m).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.where(n > 0, n, np.nan)[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.size and b.size and a.shape[1] != b.shape[1]:
        raise ValueError("vectors differ in length")
    return np.round(a @ b.T, DIGITS) if a.size and b.size else np.full((len(a), len(b)), np.nan)


def best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, columns)`` of the k greatest of each column, ties in order of
    rows, NaN last."""
    s = np.where(np.isnan(sims), -np.inf, sims)
    least = -np.partition(-s, k - 1, axis=0)[k - 1] if 0 < k < len(s) else np.full(s.shape[1], -np.inf)
    r, c = np.nonzero(s >= least)
    order = np.lexsort([r, -s[r, c], c])
    r, c = r[order], c[order]
    place = np.arange(len(c)) - np.searchsorted(c, np.arange(s.shape[1]))[c]
    return r[place < k], c[place < k]


def by_id(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The order of a column of ids."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")


@dataclass
class Index:
    """``vectors (cell, id, vec)`` with unit vectors, the pivots, and per block
    ``(cells, vectors, least angle, greatest angle)``."""
    vectors: DataFrame
    pivots: np.ndarray
    blocks: dict[int, tuple[int, int, float, float]]


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each as far as possible from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = cosines(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, cosines(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _nearest_pivot(vecs: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block and angle of unit rows; zero rows are in the zero block."""
    if not len(pivots):
        return np.full(len(vecs), ZERO_BLOCK), np.zeros(len(vecs))
    sims = cosines(vecs, pivots)
    zero = np.isnan(sims).all(axis=1)
    block = np.where(zero, ZERO_BLOCK, np.where(np.isnan(sims), -2, sims).argmax(axis=1))
    angle = np.arccos(np.clip(np.where(zero, 1.0, sims[np.arange(len(sims)), block]), -1, 1))
    return block, angle


def build(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, cell_vectors: int = CELL_VECTORS) -> Index:
    """Indexes every row of ``(id, vec)``: a sample for the pivots, one pass for
    the figures of the blocks, and one that writes."""
    spark = vectors.sparkSession
    ship_package(spark)
    some = vectors.select("vec").orderBy(F.xxhash64("vec")).limit(sample).collect()
    rows = unit(matrix(pa.array([r["vec"] for r in some], pa.list_(pa.float64()))))
    chosen = spread_pivots(rows[~np.isnan(rows).any(axis=1)], pivots)

    def located(batches):
        for b in batches:
            block, angle = _nearest_pivot(unit(matrix(b.column(0))), chosen)
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), pa.array(angle)], ["block", "angle"])
    figures = vectors.select("vec").mapInArrow(located, "block bigint, angle double").groupBy("block").agg(
        F.count(F.lit(1)).alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")).collect()
    blocks = {r["block"]: (-(-r["n"] // cell_vectors), r["n"], r["least"], r["most"]) for r in figures}
    cells = np.array([blocks.get(p, (1,))[0] for p in range(len(chosen))] + [blocks.get(ZERO_BLOCK, (1,))[0]], dtype=np.int64)
    first = np.cumsum(cells) - cells        # the zero block comes last

    def dealt(batches):
        for b in batches:
            vecs = unit(matrix(b.column(1)))
            block, _ = _nearest_pivot(vecs, chosen)
            cell = first[block] + np.asarray(b.column(2)) % cells[block]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * vecs.shape[1]), pa.array(vecs.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0), flat], ["cell", "id", "vec"])
    kind = vectors.schema["id"].dataType.simpleString()
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40)).alias("row")
    held = vectors.select("id", "vec", row).mapInArrow(dealt, f"cell bigint, id {kind}, vec array<double>")
    return Index(written(held, "index"), chosen, blocks)


def _first_cells(index: Index) -> dict[int, tuple[int, int]]:
    """The first and the last cell of each block that has vectors."""
    out, at = {}, 0
    for block in [*range(len(index.pivots)), ZERO_BLOCK]:
        n = index.blocks.get(block, (1,))[0]
        if block in index.blocks:
            out[block] = (at, at + n - 1)
        at += n
    return out


def _visit(index: Index, visits: DataFrame, k: int) -> DataFrame:
    """``(q, id, sim)``: the k best of each visited cell for each query of
    ``visits (q, part, vec, cell)``."""
    kind = index.vectors.schema["id"].dataType
    asked = visits.select(F.col("cell").alias("at"), F.col("part").alias("group")).distinct()
    vectors = index.vectors.join(asked, F.col("cell") == F.col("at")).drop("at")

    def run(left, right):
        out = []
        if left.num_rows and right.num_rows:
            right = right.take(pa.array(by_id(right.column("id"))))
            vecs, q = matrix(right.column("vec")), matrix(left.column("vec"))
            number = np.asarray(left.column("q"))
            for at in range(0, len(q), TILE):
                sims = cosines(vecs, q[at:at + TILE])
                r, c = best(sims, k)
                out.append(pa.table({"q": pa.array(number[at + c]), "id": right.column("id").take(pa.array(r)),
                                     "sim": pa.array(sims[r, c], from_pandas=True)}))
        return pa.concat_tables(out) if out else pa.table({"q": pa.array([], pa.int64()), "id": right.column("id").slice(0, 0),
                                                           "sim": pa.array([], pa.float64())})
    return visits.groupBy("cell", "part").cogroup(vectors.groupBy("cell", "group")).applyInArrow(
        run, f"q bigint, id {kind.simpleString()}, sim double")


def search(index: Index, queries: DataFrame, k: int, cell_queries: int = CELL_QUERIES) -> tuple[DataFrame, DataFrame]:
    """The k most similar vectors of each row of ``(q bigint, vec)``, ``q``
    being unique: ``(q, rank, id, sim)``; and the visits ``(q, part, vec,
    cell)`` after the first, for figures of what was skipped."""
    spark = queries.sparkSession
    ship_package(spark)
    pivots, blocks, cells = index.pivots, index.blocks, _first_cells(index)
    real = sorted(b for b in blocks if b != ZERO_BLOCK)
    enough = sum(blocks[b][1] for b in real) >= k
    least, most = (np.array([blocks[b][i] for b in real]) for i in (2, 3))

    def bounds(batches):
        """Home block, and for each block the least similarity bound."""
        for b in batches:
            vecs = unit(matrix(b.column(1)))
            home, _ = _nearest_pivot(vecs, pivots)
            angle = np.arccos(np.clip(cosines(vecs, pivots[real]), -1, 1)) if real else np.zeros((len(vecs), 0))
            near = np.maximum(np.maximum(angle - most, least - angle) - SLACK, 0)
            reach = np.where(np.isnan(near), 2.0, np.cos(np.minimum(near, np.pi)))   # the greatest similarity possible
            ends = pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * len(real))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * vecs.shape[1]), pa.array(vecs.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat, pa.array(home.astype(np.int64)),
                                              pa.ListArray.from_arrays(ends, pa.array(reach.ravel()))], ["q", "vec", "home", "reach"])
    n = queries.count()
    part = F.pmod(F.xxhash64("q"), F.lit(max(1, -(-n // cell_queries)))).alias("part")
    placed = written(queries.select("q", "vec").mapInArrow(bounds, "q bigint, vec array<double>, home bigint, reach array<double>")
                     .select("*", part), "queries")
    where = spark.createDataFrame([(b, i, *cells[b]) for i, b in enumerate(real)], "block bigint, place int, low bigint, high bigint")
    each_cell = F.explode(F.sequence("low", "high")).alias("cell")
    home = placed.join(F.broadcast(where), F.col("home") == F.col("block")).select("q", "part", "vec", each_cell)
    found = written(_visit(index, home, k), "found")
    order = Window.partitionBy("q").orderBy(F.col("sim").desc_nulls_last(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    kth = ranked.where((F.col("rank") == k) & F.col("sim").isNotNull()).select("q", F.col("sim").alias("kth"))
    bounded = placed.join(kth, "q", "left")
    open_blocks = bounded.select("q", "part", "vec", "home", "kth", F.posexplode("reach").alias("place", "near")) \
        .where(F.col("kth").isNull() | (F.col("near") >= F.col("kth")))
    visits = open_blocks.join(F.broadcast(where), "place").where(F.col("block") != F.col("home")).select("q", "part", "vec", each_cell)
    if ZERO_BLOCK in cells:
        # a zero query takes the smallest ids of all
        low, high = (F.lit(c).cast("bigint") for c in cells[ZERO_BLOCK])
        asking = placed.where(F.col("home") == ZERO_BLOCK) if enough else placed
        visits = visits.unionByName(asking.select("q", "part", "vec", F.explode(F.sequence(low, high)).alias("cell")))
    visits = written(visits, "visits")
    got = found.unionByName(_visit(index, visits, k)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return got.select("q", F.col("rank").cast("bigint").alias("rank"), "id", "sim"), visits
