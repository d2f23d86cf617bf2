"""Pruned search against sorting all similarities."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import search
from wordloom.operators import vectors as vx
from wordloom.plans import catalog

SF01 = "/root/testdata/sf0.01"


def brute(rows, queries, k, sign=1):
    def cos(a, b):
        n = np.sqrt(np.dot(a, a) * np.dot(b, b))
        return round(float(np.dot(a, b) / n), 9) if n else None
    out = {}
    for q, v in queries:
        sims = sorted(((cos(v, x), i) for i, x in rows), key=lambda s: (s[0] is None, -sign * (s[0] or 0), s[1]))[:k]
        out[q] = [(i, s) for s, i in sims]
    return out


def rows_of(df, k):
    got = {}
    for r in df.collect():
        got.setdefault(r[0], {})[r["rank"]] = (r["id"], None if r["sim"] is None else round(r["sim"], 9))
    return {q: [v[i] for i in range(1, len(v) + 1)] for q, v in got.items()}


def clustered(n, dim, groups, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    rows = [(i, (centres[i % groups] + 0.1 * rng.normal(size=dim)).tolist()) for i in range(n)]
    rows += [(n + i, [1.0] * dim) for i in range(200)]            # a hot vector
    rows += [(2 * n + i, [0.0] * dim) for i in range(5)]
    return rows


@pytest.mark.parametrize("pivots, cell_vectors, cell_queries", [(12, 10_000, 100), (5, 40, 7), (1, 1_000, 1_000)])
def test_every_split_gives_the_exact_answer(spark, pivots, cell_vectors, cell_queries):
    rows = clustered(400, 8, 12)
    v = spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(4)
    asked = [(1000 + i, rows[i][1]) for i in range(0, 600, 20)] + [(7, [0.0] * 8), (8, [-1.0] * 8)]
    q = spark.createDataFrame(asked, "q bigint, vec array<double>").repartition(3)
    index = search.build(v, pivots=pivots, cell_vectors=cell_vectors)
    assert sum(b[1] for b in index.blocks.values()) == len(rows)
    got, visits = search.search(index, q, 6, cell_queries)
    assert rows_of(got, 6) == brute(rows, asked, 6)
    if pivots == 12:
        blocks = len([b for b in index.blocks if b >= 0])
        assert visits.where("q <> 7").count() < 0.5 * (len(asked) - 1) * (blocks - 1)     # most blocks are never visited


def test_few_vectors_and_none(spark):
    rows = [(i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 0.0], [0.6, 0.8]])]
    v = spark.createDataFrame(rows, "id bigint, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "q bigint, vec array<double>")
    got, _ = search.search(search.build(v), q, 5)
    assert rows_of(got, 5) == {1: [(0, 1.0), (2, 0.6), (1, None)], 2: [(0, None), (1, None), (2, None)]}
    for a, b in ((v.limit(0), q), (v, q.limit(0))):
        assert search.search(search.build(a), b, 5)[0].count() == 0
    same = spark.createDataFrame([(3, [0.0, 0.0])], "id bigint, vec array<double>")
    assert rows_of(search.search(search.build(same), q, 5)[0], 5) == {1: [(3, None)], 2: [(3, None)]}


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_string_ids_and_both_directions(spark, sign):
    rnd = random.Random(3)
    rows = [(f"é{i % 7}-{i}", [float(rnd.randint(-2, 2)) for _ in range(3)]) for i in range(200)]
    rows = [r for r in rows if any(r[1])]
    v = spark.createDataFrame(rows, "id string, vec array<double>")
    asked = [(f"q{i}", rows[i][1]) for i in range(15)]
    q = spark.createDataFrame(asked, "query_id string, qvec array<double>")
    assert rows_of(vx.nearest_indexed(v, q, 5, sign), 5) == brute(rows, asked, 5, sign)


def test_both_ways_of_searching_agree(spark):
    v, q = catalog.emb_vectors(spark, SF01), catalog.twentieth_queries(spark, SF01)
    a = vx.nearest(v, q, k=10).withColumn("sim", F.round("sim", 9))
    b = vx.nearest_indexed(v, q, k=10).withColumn("sim", F.round("sim", 9))
    assert a.count() == 250 and a.exceptAll(b).count() == 0
