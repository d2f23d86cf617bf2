"""Vocabulary bounds, integer filter, Huffman invariants and vector queries."""

import heapq

import pytest
from pyspark.sql import functions as F

from wordloom.operators import huffman as hf
from wordloom.operators import skipgram as sg
from wordloom.operators import tfidf as tfo
from wordloom.operators import vectors as vx
from wordloom.operators import vocab as vo

SF001 = "/root/testdata/sf0.001"


def test_bounds_are_strict(spark):
    # total = 2000 -> max_count = floor(2000 * 0.005) = 10
    counts = spark.createDataFrame(
        [("low", 8), ("keep", 9), ("top", 10), ("over", 11), ("rest", 1962)], "word string, count bigint")
    kept = {r["word"] for r in vo.vocabulary(counts).collect()}
    assert kept == {"keep"}
    over = {r["word"] for r in vo.overfrequent(counts).collect()}
    assert over == {"over", "rest"}          # "top" sits on the bound: neither


def test_long_integers_dropped(spark):
    # the byte length counts the sign: "+1234567" is 8 bytes and is dropped
    v = spark.createDataFrame([("+123456", 9), ("+1234567", 9), ("1234567", 9), ("12345678", 9),
                               ("007", 9), ("-", 9), ("1e5", 9), ("12345678\r", 9), ("12345678\u2028", 9)],
                              "word string, count bigint")
    ints = {r["word"]: r["dropped"] for r in vo.integer_words(v).collect()}
    assert ints == {"+123456": False, "+1234567": True, "1234567": False, "12345678": True, "007": False}
    assert {r["word"] for r in vo.drop_long_integers(v).collect()} == {"+123456", "1234567", "007", "-", "1e5",
                                                                      "12345678\r", "12345678\u2028"}


def test_fixture_counts(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    assert vo.tree_vocabulary(docs).count() == 916


def heap_cost(ws):
    h = list(ws)
    heapq.heapify(h)
    c = 0
    while len(h) > 1:
        a, b = heapq.heappop(h), heapq.heappop(h)
        c += a + b
        heapq.heappush(h, a + b)
    return c


def test_huffman_invariants(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    vocab = vo.tree_vocabulary(docs)
    codes = hf.huffman_codes(vocab)
    paths = hf.huffman_paths(codes)
    s = hf.summary(codes, paths).collect()[0]
    assert s["n_words"] == 916 and s["n_internal"] == 915 and s["n_both_labels"] == 915
    assert s["kraft_sum"] == pytest.approx(1.0, abs=1e-12)
    assert s["weighted_length"] == 262843 == heap_cost([r["count"] for r in vocab.collect()])
    rows = codes.collect()
    bits = sorted(format(r["code"], f"0{r['len']}b") for r in rows)
    assert all(not b.startswith(a) for a, b in zip(bits, bits[1:]))
    # more frequent words never get longer codes
    by_count = sorted(rows, key=lambda r: -r["count"])
    assert all(a["len"] <= b["len"] for a, b in zip(by_count, by_count[1:]))


def test_codes_are_the_same_for_any_ranges(spark):
    v = spark.createDataFrame([(f"w{i}", 9 + i % 3) for i in range(60)], "word string, count bigint")
    one = {r["word"]: (r["place"], r["len"], r["code"]) for r in hf.huffman_codes(v, ranges=1).collect()}
    assert len(set(one.values())) == 60 and sorted(p for p, _, _ in one.values()) == list(range(60))
    # ties by word: places and codes follow (count descending, word)
    order = sorted(one, key=lambda w: (-(9 + int(w[1:]) % 3), w))
    assert [one[w][0] for w in order] == list(range(60))
    for ranges in (2, 7, 40):
        assert {r["word"]: (r["place"], r["len"], r["code"]) for r in hf.huffman_codes(v, ranges=ranges).collect()} == one


def test_single_word_has_no_path(spark):
    v = spark.createDataFrame([("only", 9)], "word string, count bigint")
    codes = hf.huffman_codes(v)
    assert [(r["len"], r["code"]) for r in codes.collect()] == [(0, 0)]
    assert hf.huffman_paths(codes).count() == 0
    assert hf.huffman_codes(v.limit(0)).count() == 0


def test_pairs_keep_oov_positions(spark):
    docs = spark.createDataFrame([(1, "a x b y y y y y c")], "doc_id int, text string")
    vocab = spark.createDataFrame([("a", 9), ("b", 9), ("c", 9)], "word string, count bigint")
    got = sorted((r["pos"], r["context_pos"]) for r in sg.skipgram_pairs(docs, vocab).collect())
    # a@0, b@2, c@8: a-b within 4, b-c is 6 apart
    assert got == [(0, 2), (2, 0)]


def test_frequent_words_change_no_result(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    counts = vo.word_counts(docs)
    tree, hot = vo.tree_words(counts), vo.frequent_words(counts)
    assert 0 < hot.count() < 1 / vo.MAX_FREQ
    tokens = tfo.token_positions(docs, "C")
    for a, b in ((vo.encode(tokens, tree), vo.encode(tokens, tree, hot)),
                 (vo.known_tokens(tokens, tree), vo.known_tokens(tokens, tree, hot))):
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_vector_lookup(spark):
    v = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, vec array<double>")
    ids = spark.createDataFrame([("b",), ("x",), ("b",)], "id string")
    assert {r["id"]: r["vec"] for r in vx.lookup_vectors(v, ids).collect()} == {"b": [2.0], "x": None}


VECS = [("z", [0.0, 0.0]), ("p", [1.0, 0.0]), ("q", [1.0, 0.0]), ("n", [-1.0, 0.0]), ("d", [0.6, 0.8])]


def test_nearest_ties_zero_and_opposite(spark):
    v = spark.createDataFrame(VECS, "id string, vec array<double>")
    q = spark.createDataFrame([("p", [1.0, 0.0])], "query_id string, qvec array<double>")
    r = [(x["id"], x["sim"]) for x in vx.nearest(v, q, k=10).orderBy("rank").collect()]
    assert [i for i, _ in r] == ["p", "q", "d", "n", "z"]      # tie by id, null last
    assert r[-1][1] is None and r[3][1] == pytest.approx(-1.0)
    f = vx.farthest(v, q).collect()[0]
    assert (f["id"], f["sim"]) == ("n", pytest.approx(-1.0))
    assert vx.nearest(v, q.where("query_id = 'none'"), k=3).count() == 0


def test_query_blocks_and_ties_against_sorting(spark, monkeypatch):
    import random
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(3)]) for i in range(300)]
    v = spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(5)
    q = spark.createDataFrame([(f"q{i}", rows[i][1], [i, i + 1]) for i in range(9)],
                              "query_id string, qvec array<double>, exclude array<bigint>")

    def cos(a, b):
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 9) if n else None
    for budget in (1 << 20, 100):
        monkeypatch.setattr(vx, "MAX_QUERY_BYTES", budget)
        got = {}
        for r in vx.nearest(v, q, k=7).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["sim"])
        for i in range(9):
            sims = [(cos(rows[i][1], x), j) for j, x in rows if j not in (i, i + 1)]
            want = sorted(sims, key=lambda s: (s[0] is None, -(s[0] or 0), s[1]))[:7]
            have = [got[f"q{i}"][k] for k in range(1, 8)]
            assert [s for _, s in have] == [pytest.approx(s) for s, _ in want]


def test_differing_lengths_raise(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0])], "id string, vec array<double>")
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    with pytest.raises(Exception, match="differ in length"):
        vx.cosine_pairs(v, pairs).collect()
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, qvec array<double>")
    with pytest.raises(Exception, match="differ in length"):
        vx.nearest(v, q).collect()


def test_average_counts_untouched_rows(spark):
    base = spark.createDataFrame([(1, [1.0, 1.0]), (2, [5.0, 5.0])], "id int, vec array<double>")
    deltas = spark.createDataFrame([(1, [4.0, 0.0]), (1, [0.0, 8.0])], "id int, delta array<double>")
    out = {r["id"]: r["vec"] for r in vx.average(base, deltas, 4).collect()}
    assert out[1] == pytest.approx([2.0, 3.0]) and out[2] == [5.0, 5.0]


def test_analogy_excludes_inputs(spark):
    v = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]),
                               ("t", [0.0, 2.0]), ("u", [1.0, -1.0])], "id string, vec array<double>")
    t = spark.createDataFrame([("q", "a", "b", "c")], "query_id string, a string, b string, c string")
    r = vx.analogy(v, t, k=1).collect()
    assert [x["id"] for x in r] == ["t"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_partial_aggregation(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    for df in (vo.word_counts(docs), tfo.corpus_document_frequency(docs)):
        assert "partial_count" in plan(df) and "Python" not in plan(df)


def test_scans_and_exchanges(spark):
    """Terms are counted without a shuffle; TF-IDF scans the text twice."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    assert "Exchange" not in plan(tfo.term_counts(docs))
    p = plan(tfo.tfidf(docs))
    assert p.count("Scan parquet") == 2 and "doc_id" not in "".join(x for x in p.split("\n") if "Exchange hash" in x)
    counts = vo.word_counts(docs)
    from wordloom.session import written
    codes = hf.huffman_codes(vo.tree_words(written(counts, "counts")))
    assert "documents.parquet" not in plan(codes)


def test_python_only_in_training_and_vector_queries(spark):
    """Only the trainers' kernels, the similarity matrices and the text chunk reader run Python in tasks."""
    from wordloom.plans import catalog
    python = {"file_chunks", "node_targets", "root_targets", "nearest_twentieth", "farthest_twentieth", "hs_gradient", "sync_step", "fit_sync", "fit_local", "word_vectors", "training_report",
              "nearest", "farthest", "analogy"}
    for name, q in catalog.queries().items():
        if name not in python:
            p = plan(q(spark, SF001))
            assert "Python" not in p and "MapInArrow" not in p, name


def test_searches_over_every_twentieth_vector(spark):
    import duckdb
    from wordloom.plans import catalog, oracle
    duckdb.sql("CREATE OR REPLACE VIEW embeddings AS FROM '/root/testdata/sf0.001/embeddings.parquet'")
    for name in ("nearest_twentieth", "farthest_twentieth"):
        got = sorted(map(tuple, catalog.queries()[name](spark, "/root/testdata/sf0.001").collect()))
        want = sorted(duckdb.sql(oracle.sql()[name]).fetchall())
        assert len({r[0] for r in got}) == 25 and len(got) == len(want)
        for x, y in zip(got, want):
            assert x[:-1] == y[:-1] and abs(x[-1] - y[-1]) < 1e-5
