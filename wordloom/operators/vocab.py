"""Vocabulary: word counts, frequency bounds, integer filter, lookups.

Semantics (fixed by the reference program):

- counts over separator preset ``C`` (the active file path) by default
- kept words satisfy ``min_count < count < max_count`` with
  ``max_count = floor(total * max_freq)``; both bounds strict, so a word
  exactly on a bound is neither kept nor (for the upper one) over-frequent
- integer tokens (``^[+-]?[0-9]+$``) longer than 7 bytes, sign included,
  are left out of the code tree and so are out of vocabulary for training

Word counts are one partially aggregated count by word: a stop word is
combined map-side before the shuffle. The upper bound is a scalar subquery
computed once: from a corpus, the token total is the sum of the token-array
sizes (no explode, no shuffle); from a count table, the sum of the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import is_integer, is_long_integer, tokenize

# Training settings of the reference program.
MIN_COUNT = 8
MAX_FREQ = 0.005
MAX_INT_LEN = 7


def word_counts(corpus: DataFrame, preset: str = "C") -> DataFrame:
    """``(word, count)`` over every token of the corpus."""
    return (corpus.select(F.explode_outer(tokenize(F.col("text"), preset)).alias("word"))
            .where(F.col("word").isNotNull())
            .groupBy("word").agg(F.count(F.lit(1)).alias("count")))


def total_words(corpus: DataFrame, preset: str = "C") -> DataFrame:
    """One row ``total_words``: tokens in the corpus before any filter."""
    return corpus.agg(F.coalesce(F.sum(F.size(tokenize(F.col("text"), preset))), F.lit(0))
                      .cast("bigint").alias("total_words"))


def max_count(counts: DataFrame, max_freq: float = MAX_FREQ, total: DataFrame | None = None):
    """Scalar column ``floor(total * max_freq)``.

    ``total`` is a one-row table of the token total; by default the sum of
    the counts. From a corpus, ``total_words`` gives the same number from the
    token-array sizes alone (no explode, no shuffle).
    """
    t = (counts.agg(F.sum("count").cast("bigint").alias("t")) if total is None else total).scalar()
    return F.floor(t.cast("double") * F.lit(float(max_freq))).cast("bigint")


def vocabulary(counts: DataFrame, min_count: int = MIN_COUNT, max_freq: float = MAX_FREQ,
               total: DataFrame | None = None) -> DataFrame:
    """Kept words ``(word, count)`` with ``min_count < count < max_count``."""
    hi = max_count(counts, max_freq, total)
    return counts.where((F.col("count") > F.lit(min_count)) & (F.col("count") < hi))


def overfrequent(counts: DataFrame, max_freq: float = MAX_FREQ) -> DataFrame:
    """Words above the upper bound ``(word, count)`` (the reference logs them)."""
    return counts.where(F.col("count") > max_count(counts, max_freq))


def frequent_words(counts: DataFrame, max_freq: float = MAX_FREQ) -> DataFrame:
    """Words with more than ``max_freq`` of all tokens. Fewer than ``1 /
    max_freq`` words can be (their shares add up to at most one): 200 by
    default, which bounds the broadcasts of this table below."""
    t = counts.agg(F.sum("count").cast("double")).scalar()
    return counts.where(F.col("count") > t * F.lit(float(max_freq))).select("word")


def integer_words(vocab: DataFrame, max_len: int = MAX_INT_LEN) -> DataFrame:
    """Integer words of the vocabulary with ``dropped`` = longer than ``max_len`` bytes."""
    return (vocab.where(is_integer("word"))
            .select("word", "count", F.octet_length("word").cast("bigint").alias("n_bytes"),
                    is_long_integer("word", max_len).alias("dropped")))


def drop_long_integers(vocab: DataFrame, max_len: int = MAX_INT_LEN) -> DataFrame:
    return vocab.where(~is_long_integer("word", max_len))


def tree_words(counts: DataFrame, min_count: int = MIN_COUNT, max_freq: float = MAX_FREQ,
               max_int_len: int = MAX_INT_LEN) -> DataFrame:
    """Words of a count table that get a leaf in the code tree: ``(word, count)``."""
    return drop_long_integers(vocabulary(counts, min_count, max_freq), max_int_len)


def tree_vocabulary(corpus: DataFrame, preset: str = "C", min_count: int = MIN_COUNT,
                    max_freq: float = MAX_FREQ, max_int_len: int = MAX_INT_LEN) -> DataFrame:
    """Words that get a leaf in the code tree: ``(word, count)``."""
    kept = vocabulary(word_counts(corpus, preset), min_count, max_freq, total_words(corpus, preset))
    return drop_long_integers(kept, max_int_len)


def sorted_vocab(vocab: DataFrame) -> DataFrame:
    """Vocabulary by descending count, ties by word (a range-partitioned sort)."""
    return vocab.orderBy(F.col("count").desc(), F.col("word").asc())


def top_words(vocab: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` most frequent words (top-k: a per-partition heap, then one merge)."""
    return sorted_vocab(vocab).limit(n)


def count_histogram(vocab: DataFrame) -> DataFrame:
    """``(count, n_words)``: how many words share each count."""
    return vocab.groupBy("count").agg(F.count(F.lit(1)).alias("n_words"))


def lookup(vocab: DataFrame, words: DataFrame, word_col: str = "word") -> DataFrame:
    """Counts of the given words; unknown words keep a null count."""
    w = words.select(F.col(word_col).alias("word")).distinct()
    return w.join(vocab.select("word", "count"), "word", "left")


def encode(tokens: DataFrame, vocab: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """Tokens ``(doc_id, pos, word)`` with ``known``; positions of unknown words kept.

    ``frequent`` (see :func:`frequent_words`) are words too common to be in
    the vocabulary. Their tokens join on a key of their own row instead of the
    word, so that no stop word gathers in one task.
    """
    v = vocab.select(F.col("word").alias("_key"), F.lit(True).alias("_k"))
    key = F.col("word")
    if frequent is not None:
        tokens = tokens.join(F.broadcast(frequent.select("word", F.lit(True).alias("_hot"))), "word", "left")
        # no token holds a line end
        key = F.when(F.col("_hot"), F.concat_ws("\n", F.lit(""), F.col("doc_id"), F.col("pos"))).otherwise(F.col("word"))
    return (tokens.withColumn("_key", key).join(v, "_key", "left")
            .select("doc_id", "pos", "word", F.coalesce("_k", F.lit(False)).alias("known")))


def known_tokens(tokens: DataFrame, vocab: DataFrame, frequent: DataFrame | None = None, chunks: int | None = None) -> DataFrame:
    """Tokens whose word is in the vocabulary. ``frequent`` words, which cannot
    be, leave before the tokens are shuffled; any other word has at most
    ``max_freq`` of the tokens. Tokens that lie by their ``chunk``, of ``chunks``,
    stay there and keep it: a chunk's distinct words are joined with the
    vocabulary and brought back."""
    if frequent is not None:
        tokens = tokens.join(F.broadcast(frequent), "word", "left_anti")
    if chunks is None:
        return tokens.join(vocab.select("word"), "word", "left_semi").select("doc_id", "pos", "word")
    # counting ids keeps the column: both uses of the tokens share one exchange of the text
    words = tokens.groupBy("chunk", "word").agg(F.count("doc_id").alias("_n")).where("_n >= 0").select("chunk", "word")
    found = words.join(vocab.select("word"), "word", "left_semi").repartition(chunks, "chunk").select("chunk", "word")
    # tokens and words lie by chunk: a group by chunk and word needs no exchange, a join would make one
    at = F.struct("doc_id", "pos")
    both = tokens.select("chunk", "word", at.alias("at")).unionByName(
        found.select("chunk", "word", F.lit(None).cast(tokens.select(at.alias("at")).schema["at"].dataType).alias("at")))
    return both.groupBy("chunk", "word").agg(F.collect_list("at").alias("at"), F.max(F.col("at").isNull()).alias("known")).where("known").select(
        "chunk", "word", F.explode("at").alias("at")).select("chunk", "at.doc_id", "at.pos", "word")


def oov_rate(tokens: DataFrame, vocab: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """One row: tokens, known tokens, unknown tokens."""
    e = encode(tokens, vocab, frequent)
    return e.agg(F.count(F.lit(1)).alias("n_tokens"),
                 F.count(F.when(F.col("known"), F.lit(1))).alias("n_known"),
                 F.count(F.when(~F.col("known"), F.lit(1))).alias("n_oov"))
