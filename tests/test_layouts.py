"""Windows, posting lists, text chunks, batches and long codes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators import huffman as hf
from wordloom.operators import skipgram as sg
from wordloom.operators import tfidf as tfo
from wordloom.operators import train as tr
from wordloom.operators import vocab as vo
from wordloom.plans import catalog
from wordloom.session import scratch_path
from wordloom.sources.corpus import chunk_source, write_text_files

SF001 = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs_of(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("half", [1, 4])
def test_windows_hold_the_pairs(spark, half):
    docs = docs_of(spark)
    counts = vo.word_counts(docs)
    tree = vo.tree_words(counts)
    rows = sg.skipgram_windows(docs, tree, half)
    flat = rows.select("doc_id", "pos", "word", F.explode(F.arrays_zip("context_pos", "context")).alias("c")).select(
        "doc_id", "pos", F.col("c.context_pos").alias("context_pos"), "word", F.col("c.context").alias("context"))
    pairs = sg.skipgram_pairs(docs, tree, half)
    assert flat.count() == pairs.count() > 0
    assert flat.exceptAll(pairs).count() == 0
    assert all(list(r["context_pos"]) == sorted(r["context_pos"]) for r in rows.limit(500).collect())


def test_windows_of_short_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a b"), (3, ""), (4, "b x x a")], "doc_id int, text string")
    tree = spark.createDataFrame([("a",), ("b",)], "word string")
    got = {(r["doc_id"], r["pos"]): (r["word"], r["context_pos"], r["context"]) for r in sg.skipgram_windows(docs, tree, 4).collect()}
    assert got == {(2, 0): ("a", [1], ["b"]), (2, 1): ("b", [0], ["a"]), (4, 0): ("b", [3], ["a"]), (4, 3): ("a", [0], ["b"])}


@pytest.mark.parametrize("size", [1, 7, 128, 100_000])
def test_posting_lists_unfold_to_the_postings(spark, size):
    docs = docs_of(spark)
    blocks = tfo.posting_blocks(docs, size)
    assert blocks.where(F.size("gaps") > size).count() == 0
    got, want = tfo.unfold_postings(blocks), tfo.postings(docs)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert blocks.where(F.size("gaps") != F.size("positions")).count() == 0


def test_posting_lists_exchange_texts_only(spark):
    """postings are not exchanged, only documents, by block; lists of
    one, two and more entries, of repeated ids and of none unfold again."""
    rows = [(0, "a b c"), (1, "a b"), (2, "a"), (2, "a b"), (130, "b"), (-1, "c a"), (None, "a z"), (None, "z"), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    blocks = tfo.posting_blocks(docs)
    exchanges = [x for x in blocks._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert len(exchanges) == 1 and "hashpartitioning(block" in exchanges[0]
    got = {(r["term"], r["block"]): (r["first_doc"], r["gaps"], r["positions"]) for r in blocks.collect()}
    assert len(got) == blocks.count() == 8
    assert got["a", 0] == (0, [0, 1, 1, 0], [0, 0, 0, 0]) and got["b", 0] == (0, [0, 1, 1], [1, 1, 1])
    assert got["b", 1] == (130, [0], [0]) and got["c", -1] == (-1, [0], [1]) and got["z", None] == (None, [None, None], [0, 1])
    unfolded, want = tfo.unfold_postings(blocks), tfo.postings(docs)
    assert unfolded.count() == want.count() and unfolded.exceptAll(want).count() == want.exceptAll(unfolded).count() == 0


def test_written_postings_read_only_their_range(spark):
    df = catalog.queries()["written_postings"](spark, SF001)
    assert "PushedFilters: [IsNotNull(term), GreaterThanOrEqual(term,m), LessThan(term,n)]" in plan(df)
    assert 0 < df.count() == tfo.postings(docs_of(spark)).where("term >= 'm' AND term < 'n'").count()


TEXTS = ["", "plain", "é" * 10, "日本語" * 50, "🙂a" * 7, "x" * 64, "line\nline\n", "tail é"]


@pytest.mark.parametrize("step, run", [(1, 1), (3, 6), (16, 64), (64, 64), (1 << 20, 1 << 20)])
def test_chunks_of_files_hold_every_character_once(spark, step, run):
    rows = [(i, t, i // 3) for i, t in enumerate(TEXTS)]
    path = scratch_path(spark, "texts")
    write_text_files(spark.createDataFrame(rows, "doc_id int, text string, file int"), path, "file")
    spark.dataSource.register(chunk_source())
    read = spark.read.format("chunked_text").option("chunkBytes", step).option("partitionBytes", run)
    got = {}
    for r in read.load(path).collect():
        got.setdefault(int(r["file"].split("/")[0][5:]), {})[r["chunk"]] = r["text"]
    for f in {f for _, _, f in rows}:
        whole = "".join(t + "\n" for _, t, g in rows if g == f)
        assert sorted(got[f]) == list(range(-(-len(whole.encode()) // step)))
        assert "".join(got[f][i] for i in sorted(got[f])) == whole
        at = 0
        for i in sorted(got[f]):        # a character belongs to the chunk in which its first byte lies
            assert not got[f][i] or at // step == i
            at += len(got[f][i].encode())
    if step == 3:
        assert read.load(path).rdd.getNumPartitions() > len(got)      # one file is read by several tasks


def test_chunks_of_nothing(spark):
    path = scratch_path(spark, "texts")
    write_text_files(spark.createDataFrame([], "doc_id int, text string, file int"), path, "file")
    spark.dataSource.register(chunk_source())
    assert spark.read.format("chunked_text").load(path).count() == 0


def test_a_batch_reads_its_files_only(spark):
    docs = docs_of(spark)
    held = tr.write_batches(docs, 4)
    want = tr.assign_batches(docs, 4)
    for m in range(4):
        part = tr.select_batch(held, m)
        assert "PartitionFilters: [isnotnull(batch" in plan(part) and f"= {m})" in plan(part)
        assert sorted(r["doc_id"] for r in part.collect()) == sorted(r["doc_id"] for r in want.where(f"batch = {m}").collect())


def cost(histogram, depths):
    """Weighted length: the heaviest words get the shortest codes."""
    lengths = [d for d in sorted(depths) for _ in range(depths[d])]
    weights = sorted((c for c, n in histogram for _ in range(n)), reverse=True)
    assert len(lengths) == len(weights)
    return sum(a * b for a, b in zip(lengths, weights))


def brute_limited(weights, limit):
    """Package-merge item by item, the textbook way."""
    items = [(w, (i,)) for i, w in enumerate(weights)]
    row = []
    for _ in range(limit):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])]
        row = sorted(items + pairs, key=lambda x: x[0])
    return sum(w for w, _ in row[:2 * len(weights) - 2])


def test_limited_codes_are_the_best_that_fit():
    rnd = random.Random(8)
    for _ in range(200):
        hist = [(rnd.randrange(1, 60) ** 2, rnd.randrange(1, 4)) for _ in range(rnd.randrange(1, 9))]
        hist = sorted({c: n for c, n in hist}.items())
        n = sum(m for _, m in hist)
        free = hf.depth_counts(hist)
        if n < 2:
            assert hf.limited_depth_counts(hist, 5) == free
            continue
        assert cost(hist, hf.limited_depth_counts(hist, 62)) == cost(hist, free)
        for limit in range(math.ceil(math.log2(n)), max(free) + 1):
            got = hf.limited_depth_counts(hist, limit)
            assert max(got) <= limit and sum(m * 2.0 ** -d for d, m in got.items()) == 1
            assert cost(hist, got) == brute_limited([c for c, m in hist for _ in range(m)], limit)
    with pytest.raises(ValueError, match="longer"):
        hf.limited_depth_counts([(1, 5)], 2)


def test_codes_of_fibonacci_counts_fit(spark):
    fib = [1, 2]
    while len(fib) < 80:
        fib.append(fib[-1] + fib[-2])
    assert max(hf.depth_counts([(c, 1) for c in fib])) > hf.MAX_CODE_LEN
    vocab = spark.createDataFrame([(f"w{i}", c) for i, c in enumerate(fib)], "word string, count bigint")
    codes = hf.huffman_codes(vocab).collect()
    assert len(codes) == 80 and max(r["len"] for r in codes) == hf.MAX_CODE_LEN
    assert sum(2.0 ** -r["len"] for r in codes) == 1
    texts = [format(r["code"], f"0{r['len']}b") for r in codes]
    assert not any(a != b and b.startswith(a) for a in texts for b in texts)
    paths = hf.huffman_paths(hf.huffman_codes(vocab))
    assert paths.where("node <= 0").count() == 0 and paths.select("node").distinct().count() == 79
