"""wordloom: corpus statistics and word vectors as Spark DataFrame jobs.

Every operator takes and returns DataFrames and is built from Spark's own
expressions, joins, aggregations and windows, so Catalyst plans the work and
it scales with the cluster. Sub-packages:

- ``sources``    corpus scans, JSON records, fixed-length chunks, sinks
- ``functions``  column expressions (tokenizer, vector arithmetic, hashing)
- ``operators``  TF-IDF, vocabulary, skip-gram, Huffman codes, training,
                 vector queries
- ``plans``      the query catalogue used by the entry point and the bench
"""

from wordloom.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
