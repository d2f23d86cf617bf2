"""Exact, unsmoothed TF-IDF and the inverted index.

Semantics (fixed by the reference program):

- tokens: separator preset ``A``, ASCII lower-casing, empty tokens dropped
- ``tf = cnt / total`` where ``total`` counts every token of the document
- ``N`` = rows of the document table, empty documents included
- ``idf = ln(N / df)`` with no smoothing, narrowed to float as the reference
  sends it; ``tf_idf = tf * idf`` in double. ``idf = 0`` rows are kept.

Plan shape. A document is one row, so its terms are counted inside the row
(sorted tokens, run boundaries) and (document, term) rows are never shuffled.
Document frequency is a partially aggregated count by term, so a hot term is
combined map-side before its shuffle. The idf table is joined back on
``term``: AQE broadcasts it when its runtime size is under the threshold,
otherwise it is a sort-merge join whose skewed (stop-word) partitions AQE
splits. N comes from the check that document ids are unique, which reads the
id column only, so the text is scanned twice in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.arrays import value_counts
from wordloom.functions.text import tokenize
from wordloom.sources.corpus import check_unique_ids, unique_ids

BLOCK_DOCS = 128    # documents in a block of the inverted index
PART_BYTES = 4 << 20    # bytes of text whose postings a task holds, as expected


def tokenized(corpus: DataFrame, preset: str = "A") -> DataFrame:
    """``(doc_id, words)``; narrow."""
    return corpus.select("doc_id", tokenize(F.col("text"), preset).alias("words"))


def doc_lengths(corpus: DataFrame, preset: str = "A") -> DataFrame:
    """``(doc_id, total)``: tokens per document, 0 for empty text. No shuffle."""
    return corpus.select("doc_id", F.size(tokenize(F.col("text"), preset)).cast("bigint").alias("total"))


def doc_terms(corpus: DataFrame, preset: str = "A") -> DataFrame:
    """``(doc_id, terms)``: distinct terms of each document in byte order."""
    return corpus.select("doc_id", F.array_distinct(F.sort_array(tokenize(F.col("text"), preset)))
                         .alias("terms"))


def term_counts(corpus: DataFrame, preset: str = "A", check_ids: bool = True) -> DataFrame:
    """``(doc_id, term, cnt, total)``, one row per distinct term of a document.

    Counted inside each row: no shuffle, and rows are never merged by id.
    ``check_ids`` raises on null or repeated ids (D5).
    """
    if check_ids:
        check_unique_ids(corpus)
    w = tokenize(F.col("text"), preset)
    # explode_outer: a plain explode makes Catalyst infer a size(..) > 0
    # filter that tokenizes every document a second time.
    return (corpus.select("doc_id", w.alias("_w"))
            .select("doc_id", F.size("_w").cast("bigint").alias("total"),
                    F.explode_outer(value_counts(F.col("_w"))).alias("_t"))
            .where(F.col("_t").isNotNull())
            .select("doc_id", F.col("_t.value").alias("term"), F.col("_t.cnt").alias("cnt"), "total"))


def tf(corpus: DataFrame, preset: str = "A", check_ids: bool = True) -> DataFrame:
    """``(doc_id, term, cnt, total, tf)``."""
    tc = term_counts(corpus, preset, check_ids)
    return tc.select("doc_id", "term", "cnt", "total",
                     (F.col("cnt") / F.col("total")).alias("tf"))


def doc_count(corpus: DataFrame) -> DataFrame:
    """One row ``n_docs``: rows of the document table."""
    return corpus.agg(F.count(F.lit(1)).alias("n_docs"))


def document_frequency(tc: DataFrame) -> DataFrame:
    """``(term, df)`` from term-count rows; partial aggregation before the shuffle."""
    return tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_document_frequency(corpus: DataFrame, preset: str = "A") -> DataFrame:
    """``(term, df)`` straight from the documents: each row's distinct terms,
    then a partially aggregated count by term (no (doc, term) shuffle)."""
    terms = F.array_distinct(tokenize(F.col("text"), preset))
    return (corpus.select(F.explode_outer(terms).alias("term"))
            .where(F.col("term").isNotNull())
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def idf(corpus: DataFrame, preset: str = "A", n_docs: int | None = None) -> DataFrame:
    """``(term, df, idf)`` with ``idf = float(ln(N / df))``; N is counted
    unless it is given."""
    n_docs = doc_count(corpus).scalar() if n_docs is None else F.lit(n_docs)
    return (corpus_document_frequency(corpus, preset)
            .select("term", "df",
                    F.ln(n_docs.cast("double") / F.col("df")).cast("float").alias("idf")))


def postings(corpus: DataFrame, preset: str = "A", *keep: str) -> DataFrame:
    """Inverted index in long form ``(term, doc_id, pos)``, with the columns ``keep``.

    ``pos`` is the term's slot among the document's sorted distinct terms
    (where the reference sends the idf back to). Narrow: built per row.

    Kept long (one row per posting) and written clustered by term; a list per
    term would put a stop word's whole posting list in one row.
    """
    terms = F.array_distinct(F.sort_array(tokenize(F.col("text"), preset)))
    return (corpus.select("doc_id", *keep, F.posexplode(terms).alias("pos", "term"))
            .select("term", "doc_id", F.col("pos").cast("bigint").alias("pos"), *keep))


def posting_blocks(corpus: DataFrame, docs_per_block: int = BLOCK_DOCS, preset: str = "A") -> DataFrame:
    """Inverted index as lists: ``(term, block, first_doc, gaps, positions)``.

    A block is a range of ``docs_per_block`` document ids (bigint), so a list
    has at most that many entries however common the term is, and a stop word's
    lists are built by as many tasks as it has blocks. Texts are exchanged by
    block, which holds all of its lists; postings, many times larger, stay in
    their tasks. ``gaps`` are the
    differences between neighbouring ids, the first 0, ``positions`` the
    term's slots as in :func:`postings`. The lists of a term in order of their
    blocks are its whole posting list.
    """
    size = corpus.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    parts = max(2 * corpus.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    block = F.floor(F.col("doc_id") / F.lit(docs_per_block)).cast("bigint")
    # a given number of partitions: texts are much smaller than what they are unfolded to
    docs = corpus.withColumn("block", block).repartition(parts, "block")
    rows = postings(docs, preset, "block")
    lists = rows.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "pos"))).alias("p"))
    ids = F.col("p.doc_id")
    before = F.concat(F.slice(ids, 1, 1), F.slice(ids, 1, F.size("p") - 1))
    return lists.select("term", "block", ids[0].alias("first_doc"), F.zip_with(ids, before, lambda x, y: x - y).alias("gaps"),
                        F.col("p.pos").alias("positions"))


def unfold_postings(blocks: DataFrame) -> DataFrame:
    """The postings ``(term, doc_id, pos)`` of :func:`posting_blocks`. Ids are
    running sums of gaps; a list is as short as its block."""
    start = F.struct(F.col("first_doc").alias("doc"), F.array().cast("array<bigint>").alias("ids"))
    first, n = F.col("first_doc"), F.size("gaps")
    many = F.aggregate("gaps", start, lambda a, g: F.struct((a["doc"] + g).alias("doc"), F.array_append(a["ids"], a["doc"] + g).alias("ids")),
                       lambda a: a["ids"])
    # most lists have one or two entries
    ids = F.when(n == 1, F.array(first)).when(n == 2, F.array(first, first + F.get("gaps", F.lit(1)))).otherwise(many)
    return blocks.select("term", F.explode(F.arrays_zip(ids.alias("doc_id"), F.col("positions").alias("pos"))).alias("p")) \
        .select("term", "p.doc_id", "p.pos")


def tfidf(corpus: DataFrame, preset: str = "A") -> DataFrame:
    """Long-form TF-IDF ``(doc_id, term, cnt, total, tf, df, idf, tf_idf)``.

    First verifies that document ids are unique and not null and raises
    otherwise (N and the per-document rows assume one row per document); that
    check also counts N. Then two scans of the text: one for the (document,
    term) rows, the other for the document frequencies.
    """
    n_docs = unique_ids(corpus)
    tc = term_counts(corpus, preset, check_ids=False)
    return (tc.join(idf(corpus, preset, n_docs), "term")
            .select("doc_id", "term", "cnt", "total",
                    (F.col("cnt") / F.col("total")).alias("tf"),
                    "df", "idf",
                    ((F.col("cnt") / F.col("total")) * F.col("idf").cast("double")).alias("tf_idf")))


def tfidf_vectors(corpus: DataFrame, preset: str = "A") -> DataFrame:
    """Per document, aligned arrays sorted by term: ``(doc_id, terms, tf, tf_idf)``.

    The term rows, with one row of null term for a document without any, are
    joined to the idf table and regrouped by document (a document's terms were
    one row to begin with, so a group is bounded by a row).
    """
    n_docs = unique_ids(corpus)
    w = tokenize(F.col("text"), preset)
    rows = (corpus.select("doc_id", w.alias("_w"))
            .select("doc_id", F.size("_w").alias("total"), F.explode_outer(value_counts(F.col("_w"))).alias("_t"))
            # a null term would send all empty documents to one task
            .select("doc_id", F.coalesce(F.col("_t.value"), F.concat(F.lit("\n"), F.col("doc_id").cast("string"))).alias("term"),
                    (F.col("_t.cnt") / F.col("total")).alias("tf")))
    got = rows.join(idf(corpus, preset, n_docs).select("term", "idf"), "term", "left").select(
        "doc_id", F.when(F.col("tf").isNotNull(), F.struct("term", "tf", (
            F.col("tf") * F.col("idf").cast("double")).alias("tf_idf"))).alias("_v"))
    return (got.groupBy("doc_id").agg(F.sort_array(F.collect_list("_v")).alias("_v"))
            .select("doc_id", F.col("_v.term").alias("terms"), F.col("_v.tf").alias("tf"),
                    F.col("_v.tf_idf").alias("tf_idf")))


def empty_documents(corpus: DataFrame, preset: str = "A") -> DataFrame:
    """One row: documents, documents with no token, documents with tokens."""
    n = F.size(tokenize(F.col("text"), preset))
    return corpus.agg(F.count(F.lit(1)).alias("n_docs"),
                      F.count(F.when(n == 0, F.lit(1))).alias("n_empty"),
                      F.count(F.when(n > 0, F.lit(1))).alias("n_nonempty"))


def token_positions(corpus: DataFrame, preset: str = "C", keep: list[str] | None = None) -> DataFrame:
    """``(doc_id, pos, word)``: every token with its 0-based position, before
    them the columns ``keep``. Narrow."""
    keep = keep or []
    return (corpus.select(*keep, "doc_id", F.posexplode(tokenize(F.col("text"), preset)).alias("pos", "word"))
            .select(*keep, "doc_id", F.col("pos").cast("bigint").alias("pos"), "word"))
