"""Queries over vectors: cosine, nearest, farthest, analogy, sums and averages.

A vector table is ``(id, vec array<double>)``; ids may be words or numbers.

Exact nearest neighbours: a short list of queries, up to ``MAX_QUERY_BYTES``,
is broadcast as one matrix; each task multiplies it with its Arrow batches of
vectors and keeps the k best rows of each query, so vectors are scanned once
and never collected. A longer list stays a distributed table and meets only
the blocks of vectors that pivots cannot exclude (``search``). Both are exact
and give the same rows.

Element-wise sums use MLlib's ``Summarizer`` aggregate, which runs in the
JVM with partial aggregation: a hot key (the root node, a common word) is
combined map-side before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import vector as V
from wordloom.operators import search
from wordloom.operators.search import TILE, best, by_id, cosines, matrix, unit
from wordloom.session import ship_package, written

# Broadcast budget for query vectors (bytes of doubles).
MAX_QUERY_BYTES = 64 * 1024 * 1024


def as_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), V.as_double(vec_col).alias("vec"))


def lookup_vectors(vectors: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """``(id, vec)`` of the given ids, each once; unknown ids keep a null vector."""
    wanted = ids.select(F.col(id_col).alias("id")).distinct()
    return wanted.join(vectors.select("id", "vec"), "id", "left")


def cosine_pairs(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, cos)`` for given id pairs ``(a, b)``; zero vectors give null."""
    va = vectors.select(F.col("id").alias("a"), F.col("vec").alias("_va"))
    vb = vectors.select(F.col("id").alias("b"), F.col("vec").alias("_vb"))
    return (pairs.select("a", "b").join(va, "a").join(vb, "b")
            .select("a", "b", V.cosine("_va", "_vb").alias("cos")))


def score_pairs(vectors: DataFrame, pairs: DataFrame, scale: float = 1.0) -> DataFrame:
    """``(a, b, dot, score)``: clipped logistic of ``scale * dot``."""
    va = vectors.select(F.col("id").alias("a"), F.col("vec").alias("_va"))
    vb = vectors.select(F.col("id").alias("b"), F.col("vec").alias("_vb"))
    d = (pairs.select("a", "b").join(va, "a").join(vb, "b")
         .select("a", "b", V.dot("_va", "_vb").alias("dot")))
    x = d.withColumn("_x", F.col("dot") * F.lit(float(scale)))
    return x.select("a", "b", "dot", V.clipped_logistic(F.col("_x")).alias("score"))


def _best(vectors: DataFrame, block: list, k: int, sign: float) -> DataFrame:
    """``(query_id, id, sim)``: per task, the ``k`` rows of each query with the
    greatest ``sign * similarity`` (ties by id, zero vectors last)."""
    spark = vectors.sparkSession
    bc = spark.sparkContext.broadcast(sign * unit(matrix(pa.array([r["qvec"] for r in block], pa.list_(pa.float64())))))

    def run(batches):
        q, kept = bc.value, None
        for b in batches:
            if not b.num_rows or not len(q):
                continue
            vecs = unit(matrix(b.column(1)))
            for at in range(0, len(q), TILE):
                sims = cosines(vecs, q[at:at + TILE])
                order = by_id(b.column(0))
                r, c = best(sims[order], k)
                r = order[r]
                here = pa.table({"q": pa.array(at + c), "id": b.column(0).take(pa.array(r)), "sim": pa.array(sims[r, c], from_pandas=True)})
                kept = here if kept is None else pa.concat_tables([kept, here])
            if kept.num_rows > 4 * k * len(q):
                kept = _least(kept, k)
        if kept is not None:
            yield from _least(kept, k).combine_chunks().to_batches()

    ship_package(spark)
    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "vec").mapInArrow(run, f"q bigint, id {kind}, sim double")


def _least(rows: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows of each query by falling similarity and id."""
    rows = rows.sort_by([("q", "ascending"), ("sim", "descending"), ("id", "ascending")])
    q = np.asarray(rows.column("q"))
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return rows.filter(pa.array(place < k))


def _ranked(vectors: DataFrame, queries: DataFrame, k: int, sign: float = 1.0) -> DataFrame:
    """Queries whose vectors take at most ``MAX_QUERY_BYTES`` are one broadcast
    matrix, scanned against once; more go through the pivots of ``search``."""
    if "exclude" not in queries.columns:
        queries = queries.withColumn("exclude", F.lit(None).cast(f"array<{vectors.schema['id'].dataType.simpleString()}>"))
    asked = written(queries.select(F.monotonically_increasing_id().alias("q"), "query_id", "qvec", "exclude"), "asked")
    size = asked.agg(F.sum(8 * F.size("qvec") + 64).alias("bytes"), F.max(F.size("exclude")).alias("skip")).first()
    more = k + max(0, size["skip"] or 0)
    if (size["bytes"] or 0) <= MAX_QUERY_BYTES:
        block = asked.select("q", "qvec").orderBy("q").collect()
        number = spark_rows(vectors, [(i, r["q"]) for i, r in enumerate(block)])
        got = _best(vectors, block, more, sign).withColumnRenamed("q", "i").join(number, "i").select("q", "id", "sim")
    else:
        got = indexed(vectors, asked.select("q", F.col("qvec").alias("vec")), more, sign)
    found = got.join(asked.select("q", "query_id", "exclude"), "q") \
        .where(F.coalesce(~F.array_contains("exclude", F.col("id")), F.lit(True)))
    order = Window.partitionBy("q").orderBy(F.col("sim").desc_nulls_last(), F.col("id").asc())
    sim = F.col("sim") * sign + 0.0      # no negative zero
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id", sim.alias("sim"))


def spark_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, "i bigint, q bigint")


def indexed(vectors: DataFrame, queries: DataFrame, k: int, sign: float = 1.0) -> DataFrame:
    """``(q, id, sim)`` for ``(q, vec)`` through pivots, ``sim`` times ``sign``:
    the farthest vectors of a query are the nearest of its opposite."""
    asked = queries if sign > 0 else queries.withColumn("vec", V.scale("vec", sign))
    return search.search(search.build(vectors.select("id", "vec")), asked, k)[0].select("q", "id", "sim")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Top-k most similar vectors per query: ``(query_id, rank, id, sim)``.

    ``queries`` is ``(query_id, qvec)`` with, optionally, ``exclude``, an
    array of ids that are no answers. Ties by id; null similarities (zero
    vectors) sort last.
    """
    return _ranked(vectors, queries, k)


def nearest_indexed(vectors: DataFrame, queries: DataFrame, k: int = 10, sign: float = 1.0) -> DataFrame:
    """As :func:`nearest`, through the pivots whatever the number of queries;
    ``sign`` -1 gives the least similar ones."""
    asked = written(queries.select(F.monotonically_increasing_id().alias("q"), "query_id", F.col("qvec").alias("vec")), "asked")
    got = indexed(vectors, asked.select("q", "vec"), k, sign).join(asked.select("q", "query_id"), "q")
    order = Window.partitionBy("q").orderBy(F.col("sim").desc_nulls_last(), "id")
    return got.withColumn("rank", F.row_number().over(order)).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "id", (F.col("sim") * sign + 0.0).alias("sim"))


def farthest(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Least similar vector per query ``(query_id, id, sim)``; ties by smallest
    id, zero vectors are no answers."""
    return _ranked(vectors, queries, 1, -1.0).where(F.col("sim").isNotNull()).select("query_id", "id", "sim")


def analogy(vectors: DataFrame, triples: DataFrame, k: int = 1) -> DataFrame:
    """``a - b + c`` answered by cosine, the three inputs excluded.

    ``triples`` is ``(query_id, a, b, c)`` of ids; output as ``nearest``.
    Triples with an unknown id give no rows.
    """
    vec = vectors.select("id", "vec")
    t = (triples.join(vec.select(F.col("id").alias("a"), F.col("vec").alias("_a")), "a")
         .join(vec.select(F.col("id").alias("b"), F.col("vec").alias("_b")), "b")
         .join(vec.select(F.col("id").alias("c"), F.col("vec").alias("_c")), "c"))
    q = t.select("query_id", V.add(V.sub("_a", "_b"), "_c").alias("qvec"), F.array("a", "b", "c").alias("exclude"))
    return nearest(vec, q, k=k)


def components(vectors: DataFrame, k: int) -> DataFrame:
    """First ``k`` components ``(id, comps)``."""
    return vectors.select("id", F.slice("vec", 1, k).alias("comps"))


def vector_stats(df: DataFrame, key: str | list[str], vec_col: str, extra: dict | None = None) -> DataFrame:
    """``(key..., n, vec_sum, vec_mean)`` element-wise over ``array<double>`` rows.

    Summarizer is a JVM aggregate with partial aggregation; sums are
    ``mean * n`` as Summarizer keeps them, equal to a plain sum up to
    rounding. ``extra``: further aggregates by the name they get.
    """
    keys = [key] if isinstance(key, str) else list(key)
    extra = extra or {}
    s = Summarizer.metrics("count", "sum", "mean").summary(array_to_vector(F.col(vec_col)))
    return (df.groupBy(*keys).agg(s.alias("_s"), *[e.alias(n) for n, e in extra.items()])
            .select(*keys, *extra, F.col("_s.count").cast("bigint").alias("n"),
                    vector_to_array(F.col("_s.sum")).alias("vec_sum"),
                    vector_to_array(F.col("_s.mean")).alias("vec_mean")))


def vector_sum(df: DataFrame, key: str | list[str], vec_col: str) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return vector_stats(df, keys, vec_col).select(*keys, "n", F.col("vec_sum").alias(vec_col))


def average(base: DataFrame, deltas: DataFrame, replicas: int, key: str = "id") -> DataFrame:
    """Parameter averaging: ``base + sum(delta) / P`` per key.

    ``deltas`` ``(key, delta)`` holds each replica's change of the rows it
    touched; an untouched row (or an empty replica) counts as unchanged, so
    dividing by the configured replica count P is exact. Keys with no delta
    keep their base vector.
    """
    if replicas <= 0:
        raise ValueError("replica count must be positive")
    summed = vector_sum(deltas, key, "delta")
    return (base.join(summed, key, "left")
            .select(key, F.when(F.col("delta").isNull(), F.col("vec"))
                    .otherwise(V.add("vec", V.scale("delta", 1.0 / replicas))).alias("vec")))
