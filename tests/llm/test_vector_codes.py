import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from wordloom.llm import queries
from wordloom.llm import vector_codes as vc

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string, id int"


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op13_vector_codes"])
    got = queries.op13_vector_codes(spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def brute(rows):
    """The contract, part by part and entry by entry."""
    def whole(v):
        return v is not None and all(c is not None and math.isfinite(c) for c in v)
    kept = [(i, lab, [math.floor(256 * c) for c in v]) for i, v, lab in rows if whole(v)]
    if not kept:
        return [], ""
    size = len(kept[0][2]) // 16
    part = [[v[p * size:(p + 1) * size] for _, _, v in kept] for p in range(16)]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][2]))[:64]
    books = [[part[p][r] for r in first] for p in range(16)]

    def assign(p):
        def dist(x, e):
            return sum((a - b) ** 2 for a, b in zip(x, e))
        return [min((dist(x, e), k) for k, e in enumerate(books[p])) for x in part[p]]
    for _ in range(2):
        for p in range(16):
            got = assign(p)
            for k in range(len(books[p])):
                mine = [x for x, (_, j) in zip(part[p], got) if j == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [assign(p) for p in range(16)]
    error = [sum(last[p][r][0] for p in range(16)) for r in range(len(kept))]
    code = ["".join(f"{last[p][r][1]:02x}" for p in range(16)) for r in range(len(kept))]
    label = {}
    for (_, lab, _), e in zip(kept, error):
        label[lab] = label.get(lab, 0) + e
    text = ",".join(str(c) for b in books for e in b for c in e)
    return [(i, c, e, label[lab]) for (i, lab, _), c, e in zip(kept, code, error)], hashlib.sha256(text.encode()).hexdigest()


def hard_vectors(n=150):
    rng = random.Random(5)
    def vec(spread):
        return [rng.choice([-1, 1]) * rng.random() * spread for _ in range(32)]
    rows = [(1000 - i, vec(rng.choice([0.01, 0.3, 2])), rng.choice([None, 0, 0, 0, 1])) for i in range(n)]
    tie = [0.0] * 32
    rows += [(2000 + i, tie, 0) for i in range(40)] + [rows[3], rows[3]]
    rows += [(5, None, 1), (6, [float("nan")] + tie[1:], 1), (7, [None] + tie[1:], 1), (8, [float("inf")] + tie[1:], 1),
             (9, [float("-inf")] + tie[1:], None), (None, vec(1), None)]
    return rows


@pytest.mark.parametrize("most", [100_000, 0])
def test_hard_rows_equal_brute_force(spark, most):
    rows = hard_vectors()
    df = spark.createDataFrame([(i, v, lab, "x", "y", 1) for i, v, lab in rows], SCHEMA).repartition(5)
    coded, books = vc.compress(df)
    coded = vc.with_label_error(coded.drop("label_error"), most)
    # vectors come as single precision
    exact = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    want, sha = brute(exact)
    got = [tuple(r) for r in coded.select("id", "code", "error", "label_error").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert hashlib.sha256(books.text().encode()).hexdigest() == sha


def test_few_rows_and_none(spark):
    few = [(3, [0.5] * 16, None), (1, [0.25] * 16, 2)]
    df = spark.createDataFrame([(*r, "", "", 0) for r in few], SCHEMA)
    coded, books = vc.compress(df)
    want, sha = brute(few)
    assert sorted(map(tuple, coded.select("id", "code", "error", "label_error").collect())) == sorted(want)
    coded, books = vc.compress(df.where("vec_id > 5"))
    assert books is None and coded.columns == ["id", "label", "code", "error", "label_error"] and not coded.count()


def test_candidates_hold_every_entry_in_reach():
    rng = np.random.default_rng(3)
    for spread in (3, 40, 100_000):
        index = vc.PartIndex(rng.integers(-spread, spread, (64, 4)))
        x = rng.integers(-spread, spread, (500, 4))
        d = ((x[:, None] - index.entries) ** 2).sum(axis=2)
        masks = index.candidates(x, index.radius(x))
        least = d.min(axis=1)
        for r in range(len(x)):
            near = {k for k in range(64) if d[r, k] == least[r]}
            assert near <= {k for k in range(64) if int(masks[r]) >> k & 1}
        entry, dist = index.nearest(x)
        assert (dist == least).all() and (entry == d.argmin(axis=1)).all()
    assert sum(bin(int(m)).count("1") for m in masks) < 0.5 * 64 * len(x)      # most entries are never measured


def test_lengths_and_sizes_that_raise():
    with pytest.raises(ValueError, match="differ"):
        vc._values(pa.array([[1.0] * 16, [1.0] * 32]))
    with pytest.raises(ValueError, match="multiple"):
        vc._values(pa.array([[1.0] * 15]))
    with pytest.raises(ValueError, match="beyond"):
        vc._values(pa.array([[1e30] * 16]))


def test_codes_decode_to_their_entries(spark):
    rows = [(i, v, lab) for i, v, lab in hard_vectors(70) if v and all(c is not None and math.isfinite(c) for c in v)]
    df = spark.createDataFrame([(*r, "", "", 0) for r in rows], SCHEMA)
    coded, books = vc.compress(df)
    got = {r["id"]: r for r in coded.collect()}
    vec = {r["vec_id"]: np.floor(256 * np.array(r["embedding"], dtype=np.float64)).astype(int) for r in df.collect()}
    for i, r in got.items():
        assert ((vc.decode([r["code"]], books)[0] - vec[i]) ** 2).sum() == r["error"]
