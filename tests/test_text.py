"""Tokenizer, corpus sources and TF-IDF on hand tables."""

import math

import pytest
from pyspark.sql import functions as F

from wordloom.functions.text import SEPARATORS, tokenize
from wordloom.operators import tfidf as tfo
from wordloom.sources.corpus import (check_unique_ids, chunk_documents, parse_json_corpus, read_corpus,
                                     read_file_chunks, write_result)

HAND = [
    (1, "Über ÉCOLE, don't"),
    (2, ""),
    (3, None),
    (4, "...!!!"),
    (5, "a\rb c d"),
    (6, "+1234567 12345678 007"),
    (7, "[x]-y=z|w"),
    (8, " lead trail "),
]


def toks(spark, preset):
    df = spark.createDataFrame(HAND, "doc_id int, text string")
    rows = df.select("doc_id", tokenize(F.col("text"), preset).alias("w")).collect()
    return {r["doc_id"]: r["w"] for r in rows}


def test_ascii_lowercase_only(spark):
    t = toks(spark, "A")
    # only A-Z are lowered: accented capitals stay as they are
    assert t[1] == ["Über", "École", "don", "t"]


def test_empty_null_and_punctuation(spark):
    t = toks(spark, "A")
    assert t[2] == [] and t[3] == [] and t[4] == []
    assert t[8] == ["lead", "trail"]


def test_cr_and_nbsp_are_not_separators(spark):
    t = toks(spark, "C")
    assert t[5] == ["a\rb", "c d"]


def test_presets(spark):
    assert toks(spark, "A")[7] == ["[x]-y=z|w"]
    assert toks(spark, "B")[7] == ["x", "y=z|w"]
    assert toks(spark, "C")[7] == ["x", "y", "z", "w"]
    assert set(SEPARATORS["A"]) < set(SEPARATORS["B"]) < set(SEPARATORS["C"])


def test_tfidf_semantics(spark):
    docs = spark.createDataFrame(
        [(1, "a b a"), (2, "b c"), (3, ""), (4, None)], "doc_id int, text string")
    rows = {(r["doc_id"], r["term"]): r for r in tfo.tfidf(docs).collect()}
    # N counts the empty documents too: N = 4
    assert rows[(1, "a")]["cnt"] == 2 and rows[(1, "a")]["total"] == 3
    assert rows[(1, "a")]["tf"] == pytest.approx(2 / 3)
    idf_a = float(__import__("numpy").float32(math.log(4 / 1)))
    assert rows[(1, "a")]["idf"] == pytest.approx(idf_a)
    assert rows[(1, "a")]["tf_idf"] == (2 / 3) * idf_a
    assert rows[(2, "b")]["df"] == 2
    assert len(rows) == 4
    vec = {r["doc_id"]: r for r in tfo.tfidf_vectors(docs).collect()}
    assert vec[1]["terms"] == ["a", "b"] and vec[3]["terms"] == [] and vec[4]["tf"] == []
    # sum of tf is 1 per non-empty document
    assert sum(vec[2]["tf"]) == pytest.approx(1.0)


def test_idf_zero_rows_kept(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x y")], "doc_id int, text string")
    r = {x["term"]: x for x in tfo.idf(docs).collect()}
    assert r["x"]["idf"] == 0.0 and r["x"]["df"] == 2


def test_postings_positions(spark):
    docs = spark.createDataFrame([(1, "c a b a")], "doc_id int, text string")
    r = sorted((x["term"], x["pos"]) for x in tfo.postings(docs).collect())
    assert r == [("a", 0), ("b", 1), ("c", 2)]


def test_duplicate_ids_raise(spark):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    corpus = conv.select(F.col("conv_id").alias("doc_id"), "text")
    with pytest.raises(ValueError, match="unique"):
        check_unique_ids(corpus)
    once = conv.groupBy("conv_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    check_unique_ids(once.withColumnRenamed("conv_id", "doc_id"))
    nulls = spark.createDataFrame([(None, "a"), (1, "b")], "doc_id int, text string")
    with pytest.raises(ValueError):
        check_unique_ids(nulls)
    for job in (tfo.tfidf, tfo.tf, tfo.term_counts, tfo.tfidf_vectors):
        with pytest.raises(ValueError, match="unique"):
            job(corpus)


def test_chunks(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, "abcdefg"), (3, "ab"), (4, "")], "doc_id int, text string")
    got = {}
    for r in chunk_documents(df, 3).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk"], r["text"]))
    assert sorted(got[1]) == [(0, "abc"), (1, "def")]
    assert sorted(got[2]) == [(0, "abc"), (1, "def"), (2, "g")]
    assert got[3] == [(0, "ab")] and 4 not in got
    dropped = {(r["doc_id"], r["chunk"]) for r in chunk_documents(df, 3, drop_tail=True).collect()}
    assert dropped == {(1, 0), (1, 1), (2, 0), (2, 1)}
    # code points are never split
    u = spark.createDataFrame([(1, "é😀x")], "doc_id int, text string")
    assert [r["text"] for r in chunk_documents(u, 1).orderBy("chunk").collect()] == ["é", "😀", "x"]


def test_json_records(spark):
    df = spark.createDataFrame(
        [('{"title": "t1", "content": "Hello world"}',), ('{"title": 5}',), ('{"title": "x", ',)],
        "raw string")
    rows = parse_json_corpus(df, "raw", "title", "content").collect()
    assert (rows[0]["doc_id"], rows[0]["text"], rows[0]["corrupt"]) == ("t1", "Hello world", None)
    assert (rows[1]["doc_id"], rows[1]["text"]) == ("5", "")
    assert rows[2]["corrupt"] is not None and rows[2]["doc_id"] is None


def test_write_result(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b a"), (2, "c")], "doc_id int, text string")
    out = str(tmp_path / "tfidf")
    write_result(tfo.tfidf(docs), out, cluster_by="term", num_partitions=2)
    back = spark.read.parquet(out)
    assert back.count() == 3 and set(back.columns) >= {"doc_id", "term", "tf_idf"}
    # a stop word's postings are split over files
    stop = spark.createDataFrame([(i, "the") for i in range(400)], "doc_id int, text string")
    out = str(tmp_path / "postings")
    write_result(tfo.postings(stop), out, cluster_by=["term", "doc_id"], num_partitions=4)
    files = spark.read.parquet(out).groupBy(F.col("_metadata.file_path")).count().collect()
    assert len(files) == 4 and sum(r["count"] for r in files) == 400


def test_line_ids_do_not_depend_on_the_splits(spark, tmp_path):
    for name, n in (("a.txt", 3000), ("b.txt", 7)):
        (tmp_path / name).write_text("".join(f"line {i} of {name} é\n" for i in range(n)), encoding="utf-8")
    want = {f"line {i} of {name} é": i for name, n in (("a.txt", 3000), ("b.txt", 7)) for i in range(n)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "20k", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_corpus(spark, str(tmp_path), fmt="text").collect()
            assert len(rows) == len(want)
            for r in rows:
                file, _, line = r["doc_id"].rpartition(":")
                assert file.endswith(r["text"].split()[3]) and int(line) == want[r["text"]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_other_formats(spark, tmp_path):
    docs = spark.createDataFrame([("x", "hello, world"), ("y", None)], "title string, content string")
    for fmt in ("json", "csv"):
        docs.write.format(fmt).option("header", "true").save(str(tmp_path / fmt))
        got = read_corpus(spark, str(tmp_path / fmt), fmt=fmt, id_col="title", text_col="content", options={"header": "true"})
        assert {(r["doc_id"], r["text"]) for r in got.collect()} == {("x", "hello, world"), ("y", "")}


def test_one_file_in_chunks(spark, tmp_path):
    text = "né 日本 text\nwith lines, " * 50
    path = tmp_path / "one.txt"
    path.write_text(text, encoding="utf-8")
    size = len(text.encode())
    for n in (1, 7, 100, size, 10 * size):
        rows = sorted(read_file_chunks(spark, str(path), n).collect())
        assert [r["doc_id"] for r in rows] == list(range(min(n, size)))
        assert "".join(r["text"] for r in rows) == text
        if n == 7:
            assert all(abs(len(r["text"].encode()) - size / 7) <= 4 for r in rows)
    assert read_file_chunks(spark, f"file:{path}", 3).count() == 3
    (tmp_path / "none.txt").write_text("")
    assert read_file_chunks(spark, str(tmp_path / "none.txt")).count() == 0


def test_same_answer_under_repartitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = []
        for p in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", p)
            res.append(sorted(tuple(r) for r in tfo.tfidf(docs.repartition(int(p))).collect()))
        assert res[0] == res[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
