"""The query catalogue: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Every query reads the given tables (or data Spark derives from them) in
full and runs with the operators' own settings. Keys match ``wordloom.plans.oracle.sql()`` where an exact SQL oracle
exists; the others are checked by invariants in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.operators import huffman as hf
from wordloom.operators import skipgram as sgo
from wordloom.operators import tfidf as tfo
from wordloom.operators import train as tr
from wordloom.operators import vectors as vx
from wordloom.operators import vocab as vo
from wordloom.functions import vector as V
from wordloom.functions.text import tokenize
from wordloom.session import scratch_path, written
from wordloom.sources.corpus import (chunk_documents, chunk_source, parse_json_corpus, read_corpus, read_table, write_result,
                                     write_text_files)

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_corpus(spark, f"{sf_dir.rstrip('/')}/documents.parquet")


def _tokenize(preset: str) -> Query:
    def q(spark, sf_dir):
        return tfo.tokenized(documents(spark, sf_dir), preset)
    return q


def _on_docs(fn, **kw) -> Query:
    def q(spark, sf_dir):
        return fn(documents(spark, sf_dir), **kw)
    return q


def q_json_corpus(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return parse_json_corpus(ev, "props", id_field="k", text_field="content", keep=["event_id"])


def q_json_documents(spark, sf_dir):
    """The documents as JSON records with fields ``title`` and ``content``."""
    record = F.to_json(F.struct(F.col("doc_id").alias("title"), F.col("text").alias("content")))
    records = documents(spark, sf_dir).select(record.alias("record"))
    return parse_json_corpus(records, "record", id_field="title", text_field="content")


def q_chunk_documents(spark, sf_dir):
    return chunk_documents(documents(spark, sf_dir), 1000)


def q_term_counts(spark, sf_dir):
    return tfo.term_counts(documents(spark, sf_dir), "A").select("doc_id", "term", "cnt")


def q_document_frequency(spark, sf_dir):
    return tfo.corpus_document_frequency(documents(spark, sf_dir), "A")


def q_posting_lists(spark, sf_dir):
    """The block lists, written and unfolded again."""
    return tfo.unfold_postings(written(tfo.posting_blocks(documents(spark, sf_dir)), "posting-blocks"))


def q_written_postings(spark, sf_dir):
    """The postings written by ranges of (term, document), and those of the
    terms from m to n read back: other files and row groups are skipped."""
    path = scratch_path(spark, "postings")
    write_result(tfo.postings(documents(spark, sf_dir)), path, cluster_by=["term", "doc_id"])
    return spark.read.parquet(path).where((F.col("term") >= "m") & (F.col("term") < "n"))


FILE_DOCS = 100         # documents in a text file
FILE_CHUNK_BYTES = 4_096


def q_file_chunks(spark, sf_dir):
    """The documents written as text files of 100 each and read in chunks."""
    path = scratch_path(spark, "texts")
    docs = documents(spark, sf_dir).withColumn("file", F.floor(F.col("doc_id") / F.lit(FILE_DOCS)).cast("bigint"))
    write_text_files(docs, path, "file")
    spark.dataSource.register(chunk_source())
    chunks = spark.read.format("chunked_text").option("chunkBytes", FILE_CHUNK_BYTES).load(path)
    return chunks.select(F.regexp_extract("file", r"file=(\d+)/", 1).cast("bigint").alias("file"), "chunk", "text")


def counted(spark, sf_dir, preset: str = "C") -> DataFrame:
    """Word counts, written: bounds, tree and frequent words all read them."""
    return written(vo.word_counts(documents(spark, sf_dir), preset), "counts")


def tree(spark, sf_dir) -> DataFrame:
    return vo.tree_words(counted(spark, sf_dir))


def q_word_counts(spark, sf_dir):
    return vo.word_counts(documents(spark, sf_dir))


def q_vocabulary(spark, sf_dir):
    return vo.vocabulary(vo.word_counts(documents(spark, sf_dir)))


def q_integer_tokens(spark, sf_dir):
    return vo.integer_words(vo.vocabulary(vo.word_counts(documents(spark, sf_dir))))


def q_overfrequent(spark, sf_dir):
    return vo.overfrequent(vo.word_counts(documents(spark, sf_dir)))


def q_vocabulary_b(spark, sf_dir):
    """The vocabulary of a document collection (separator preset B)."""
    return vo.vocabulary(counted(spark, sf_dir, "B"))


def q_overfrequent_b(spark, sf_dir):
    return vo.overfrequent(counted(spark, sf_dir, "B"))


def q_frequent_words(spark, sf_dir):
    return vo.frequent_words(counted(spark, sf_dir))


def q_vocab_lookup(spark, sf_dir):
    """Words of the ``benchmark`` passages looked up in the corpus vocabulary."""
    bench = read_corpus(spark, f"{sf_dir.rstrip('/')}/benchmark.parquet", id_col="item_id")
    words = tfo.token_positions(bench, "C").select("word")
    return vo.lookup(tree(spark, sf_dir), words)


def q_top_words(spark, sf_dir):
    return vo.top_words(tree(spark, sf_dir), 100)


def q_count_histogram(spark, sf_dir):
    return vo.count_histogram(tree(spark, sf_dir))


def q_encode_tokens(spark, sf_dir):
    counts = counted(spark, sf_dir)
    return vo.encode(tfo.token_positions(documents(spark, sf_dir), "C"), vo.tree_words(counts), vo.frequent_words(counts))


def q_oov_rate(spark, sf_dir):
    counts = counted(spark, sf_dir)
    return vo.oov_rate(tfo.token_positions(documents(spark, sf_dir), "C"), vo.tree_words(counts), vo.frequent_words(counts))


def q_skipgram_pairs(spark, sf_dir):
    counts = counted(spark, sf_dir)
    return sgo.skipgram_pairs(documents(spark, sf_dir), vo.tree_words(counts), frequent=vo.frequent_words(counts))


def q_skipgram_windows(spark, sf_dir):
    counts = counted(spark, sf_dir)
    return sgo.skipgram_windows(documents(spark, sf_dir), vo.tree_words(counts), frequent=vo.frequent_words(counts))


def q_cooccurrence(spark, sf_dir):
    return sgo.cooccurrence(q_skipgram_pairs(spark, sf_dir))


def embeddings(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")


def emb_vectors(spark, sf_dir) -> DataFrame:
    return vx.as_vectors(embeddings(spark, sf_dir), "vec_id", "embedding")


def consecutive_pairs(spark, sf_dir) -> DataFrame:
    """Each vector with the next id: an equi-join, one partner per vector."""
    e = embeddings(spark, sf_dir)
    return (e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
            .join(e.select(F.col("vec_id").alias("b")), "b"))


def label_queries(spark, sf_dir) -> DataFrame:
    """One query per label: the vector with the smallest id of that label."""
    e = embeddings(spark, sf_dir)
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return (first.join(e.select("vec_id", "embedding"), "vec_id")
            .select(F.col("label").alias("query_id"), V.as_double("embedding").alias("qvec")))


def label_triples(spark, sf_dir) -> DataFrame:
    """Per label, the three smallest ids as (a, b, c) of an analogy."""
    e = embeddings(spark, sf_dir)
    w = Window.partitionBy("label").orderBy("vec_id")
    top3 = e.select("label", "vec_id").withColumn("_r", F.row_number().over(w)).where("_r <= 3")
    t = top3.groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("_t"))
    return t.where(F.size("_t") == 3).select(
        F.col("label").alias("query_id"), F.col("_t")[0].alias("a"),
        F.col("_t")[1].alias("b"), F.col("_t")[2].alias("c"))


def q_cosine_pairs(spark, sf_dir):
    r = vx.cosine_pairs(emb_vectors(spark, sf_dir), consecutive_pairs(spark, sf_dir))
    return r.select("a", "b", F.round("cos", 6).alias("cos"))


def q_score_pairs(spark, sf_dir):
    r = vx.score_pairs(emb_vectors(spark, sf_dir), consecutive_pairs(spark, sf_dir), scale=20.0)
    return r.select("a", "b", F.round("dot", 6).alias("dot"), F.round("score", 6).alias("score"))


def q_nearest(spark, sf_dir):
    r = vx.nearest(emb_vectors(spark, sf_dir), label_queries(spark, sf_dir), k=10)
    return r.select("query_id", "rank", "id", F.round("sim", 6).alias("sim"))


def q_farthest(spark, sf_dir):
    r = vx.farthest(emb_vectors(spark, sf_dir), label_queries(spark, sf_dir))
    return r.select("query_id", "id", F.round("sim", 6).alias("sim"))


def twentieth_queries(spark, sf_dir) -> DataFrame:
    """Every vector whose id is divisible by 20."""
    return embeddings(spark, sf_dir).where(F.col("vec_id") % 20 == 0).select(
        F.col("vec_id").alias("query_id"), V.as_double("embedding").alias("qvec"))


def q_nearest_twentieth(spark, sf_dir):
    r = vx.nearest_indexed(emb_vectors(spark, sf_dir), twentieth_queries(spark, sf_dir), k=10)
    return r.select("query_id", "rank", "id", F.round("sim", 6).alias("sim"))


def q_farthest_twentieth(spark, sf_dir):
    r = vx.nearest_indexed(emb_vectors(spark, sf_dir), twentieth_queries(spark, sf_dir), k=1, sign=-1.0)
    return r.where(F.col("sim").isNotNull()).select("query_id", "id", F.round("sim", 6).alias("sim"))


def q_analogy(spark, sf_dir):
    r = vx.analogy(emb_vectors(spark, sf_dir), label_triples(spark, sf_dir), k=5)
    return r.select("query_id", "rank", "id", F.round("sim", 6).alias("sim"))


def q_vector_lookup(spark, sf_dir):
    """Vectors of given ids: every label value, looked up as an id, and one id beyond all."""
    e = embeddings(spark, sf_dir)
    ids = e.select(F.col("label").cast("bigint").alias("id")).unionByName(e.select((F.max("vec_id") + 1).alias("id")))
    return vx.lookup_vectors(emb_vectors(spark, sf_dir), ids)


def q_vector_components(spark, sf_dir):
    return vx.components(emb_vectors(spark, sf_dir), 5)


def q_vector_mean_by_label(spark, sf_dir):
    r = vx.vector_stats(embeddings(spark, sf_dir).withColumn("v", V.as_double("embedding")), "label", "v")
    return r.select("label", "n", V.round_vec("vec_sum").alias("vec_sum"),
                    V.round_vec("vec_mean").alias("vec_mean"))


def q_average_replicas(spark, sf_dir):
    """Base = each label's first vector; every row of the label is one replica's
    delta; P = 8 replicas."""
    base = label_queries(spark, sf_dir).select(F.col("query_id").alias("id"), F.col("qvec").alias("vec"))
    deltas = embeddings(spark, sf_dir).select(F.col("label").alias("id"), V.as_double("embedding").alias("delta"))
    r = vx.average(base, deltas, 8)
    return r.select("id", V.round_vec("vec").alias("vec"))


def q_huffman_codes(spark, sf_dir):
    return hf.huffman_codes(tree(spark, sf_dir))


def q_huffman_paths(spark, sf_dir):
    return hf.huffman_paths(hf.huffman_codes(tree(spark, sf_dir)))


def q_huffman_summary(spark, sf_dir):
    codes = written(hf.huffman_codes(tree(spark, sf_dir)), "codes")
    return hf.summary(codes, hf.huffman_paths(codes)).drop("max_len")


# Training runs with the settings of the reference: dimension 100, window 8,
# min count 8, max frequency 0.005, rate 0.025, 30 iterations in both trainers.
# Replicas stand for the reference's workers, a matter of the cluster.

def q_init_params(spark, sf_dir):
    return tr.init_word_vectors(tree(spark, sf_dir).select("word"), tr.DIM, seed=0)


def _targets(prep, named: bool = False) -> DataFrame:
    return tr.word_targets(tr.cooccurrence(prep), prep.words, named)


def q_node_targets(spark, sf_dir):
    prep = tr.prepare(documents(spark, sf_dir))
    # names go to the counts: the targets of a word are never exchanged
    named = _targets(prep, named=True)
    return tr.node_targets(named.drop("id").withColumnRenamed("word", "id")).withColumnRenamed("id", "word")


def q_root_targets(spark, sf_dir):
    return q_node_targets(spark, sf_dir).where(F.col("node") == 1).select("word", "n")


def _named(rows: DataFrame, words: DataFrame, *cols) -> DataFrame:
    """Rows ``(kind, id, ..)`` with the word or the node their id stands for."""
    is_word = F.col("kind") == "word"
    names = words.select(F.col("id").alias("_id"), "word")
    return rows.join(names, is_word & (F.col("id") == F.col("_id")), "left").select(
        "kind", "word", F.when(~is_word, F.col("id")).alias("node"), *cols)


def q_hs_gradient(spark, sf_dir):
    """The gradient at random word and node vectors, rounded to 4 digits."""
    prep = tr.prepare(documents(spark, sf_dir))
    params = written(tr.random_params(prep), "params")
    g = tr.hs_gradient(_targets(prep), params)
    return _named(g, prep.words, V.round_vec("grad", 4).alias("grad"), "n")


def q_sync_step(spark, sf_dir):
    """Random word and node vectors after one synchronous step."""
    prep = tr.prepare(documents(spark, sf_dir))
    params = written(tr.random_params(prep), "params")
    work = tr.cells(_targets(prep), prep.words.count())
    after = tr.sync_step(params, work, tr.LEARNING_RATE)
    return _named(after, prep.words, V.round_vec("vec", 6).alias("vec"))


def top3(prep) -> tr.Probes:
    """The three most frequent tree words and the analogy over them."""
    words = [r["word"] for r in prep.words.where("id < 3").orderBy("id").collect()]
    return tr.Probes(words, [tuple(words)] if len(words) == 3 else [])


def q_fit_sync(spark, sf_dir):
    return tr.vectors_of(tr.fit_sync(documents(spark, sf_dir)))


def q_training_report(spark, sf_dir):
    """Synchronous training, reported after every iteration."""
    docs = documents(spark, sf_dir)
    prep = tr.prepare(docs)
    return tr.training_report(tr.fit_sync(docs, prep=prep, probes=top3(prep)))


def q_word_vectors(spark, sf_dir):
    """Word vectors trained by local SGD with parameter averaging."""
    return tr.vectors_of(tr.fit_local(documents(spark, sf_dir), iters=tr.ITERATIONS))


def q_fit_local(spark, sf_dir):
    """Local SGD over two mini-batches an iteration with the linear schedule,
    reported after every iteration."""
    docs = documents(spark, sf_dir)
    prep = tr.prepare(docs)
    return tr.training_report(tr.fit_local(docs, iters=tr.ITERATIONS, batches=2, schedule="linear",
                                           prep=prep, probes=top3(prep)))


def q_minibatch_sizes(spark, sf_dir):
    """Four mini-batches, each selected and counted on its own."""
    docs = tr.write_batches(documents(spark, sf_dir), 4, seed=0)
    parts = [tr.select_batch(docs, m).agg(
        F.lit(m).cast("bigint").alias("batch"), F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.size(tokenize(F.col("text"), "C"))).cast("bigint").alias("n_tokens")) for m in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n_docs > 0")


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "corpus_scan": lambda s, d: documents(s, d),
        "json_corpus": q_json_corpus,
        "json_documents": q_json_documents,
        "chunk_documents": q_chunk_documents,
        "tokenize_a": _tokenize("A"),
        "tokenize_b": _tokenize("B"),
        "tokenize_c": _tokenize("C"),
        "token_positions": _on_docs(tfo.token_positions, preset="C"),
        "empty_documents": _on_docs(tfo.empty_documents),
        "term_counts": q_term_counts,
        "doc_lengths": _on_docs(tfo.doc_lengths),
        "doc_terms": _on_docs(tfo.doc_terms),
        "tf": _on_docs(tfo.tf),
        "doc_count": lambda s, d: tfo.doc_count(documents(s, d)),
        "document_frequency": q_document_frequency,
        "idf": _on_docs(tfo.idf),
        "postings": _on_docs(tfo.postings),
        "posting_blocks": _on_docs(tfo.posting_blocks),
        "posting_lists": q_posting_lists,
        "written_postings": q_written_postings,
        "file_chunks": q_file_chunks,
        "tfidf": _on_docs(tfo.tfidf),
        "tfidf_vectors": _on_docs(tfo.tfidf_vectors),
        "word_counts": q_word_counts,
        "total_words": _on_docs(vo.total_words),
        "vocabulary": q_vocabulary,
        "integer_tokens": q_integer_tokens,
        "overfrequent_words": q_overfrequent,
        "vocabulary_b": q_vocabulary_b,
        "overfrequent_words_b": q_overfrequent_b,
        "frequent_words": q_frequent_words,
        "vocab_lookup": q_vocab_lookup,
        "top_words": q_top_words,
        "count_histogram": q_count_histogram,
        "encode_tokens": q_encode_tokens,
        "oov_rate": q_oov_rate,
        "skipgram_pairs": q_skipgram_pairs,
        "skipgram_windows": q_skipgram_windows,
        "cooccurrence": q_cooccurrence,
        "cosine_pairs": q_cosine_pairs,
        "score_pairs": q_score_pairs,
        "nearest": q_nearest,
        "farthest": q_farthest,
        "nearest_twentieth": q_nearest_twentieth,
        "farthest_twentieth": q_farthest_twentieth,
        "analogy": q_analogy,
        "vector_lookup": q_vector_lookup,
        "vector_components": q_vector_components,
        "vector_mean_by_label": q_vector_mean_by_label,
        "average_replicas": q_average_replicas,
        "huffman_codes": q_huffman_codes,
        "huffman_paths": q_huffman_paths,
        "huffman_summary": q_huffman_summary,
        "init_params": q_init_params,
        "node_targets": q_node_targets,
        "root_targets": q_root_targets,
        "hs_gradient": q_hs_gradient,
        "sync_step": q_sync_step,
        "fit_sync": q_fit_sync,
        "fit_local": q_fit_local,
        "minibatch_sizes": q_minibatch_sizes,
        "word_vectors": q_word_vectors,
        "training_report": q_training_report,
    }
    return q
