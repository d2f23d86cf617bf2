"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line. Each query is fully materialised with the ``noop``
sink (every row computed, nothing collected). ``value`` is the sum of the
headline queries; ``context`` holds MLlib's TF-IDF and Word2Vec on the same
documents, whose semantics differ (smoothed idf, hashed terms; a sentence
model that drops unknown words first), reported only for scale. Both trainers
start from tables prepared before (``prepare_training``); ``_setup`` is what a
fit does once (targets, work dealt to shards), ``_iteration`` what it repeats.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from wordloom.functions.text import tokenize  # noqa: E402
from wordloom.operators import tfidf as tfo  # noqa: E402
from wordloom.operators import train as tr  # noqa: E402
from wordloom.operators import vocab as vo  # noqa: E402
from wordloom.plans import catalog  # noqa: E402
from wordloom.session import build_session  # noqa: E402


def timed(fn) -> float:
    t = time.time()
    df = fn()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - t, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus) * 2)
    docs = catalog.documents(spark, sf_dir)

    def q_tfidf():
        return tfo.tfidf(docs)

    def q_vocabulary():
        return vo.tree_vocabulary(docs)

    def q_cooccurrence():
        return catalog.q_cooccurrence(spark, sf_dir)

    def q_hs_gradient():
        return catalog.q_hs_gradient(spark, sf_dir)

    def q_nearest():
        return catalog.q_nearest(spark, sf_dir)

    def q_analogy():
        return catalog.q_analogy(spark, sf_dir)

    prepared = []

    def q_prepare():
        prepared.append(tr.prepare(docs))
        return prepared[0].words

    def iteration(fit):
        """Seconds of one iteration and of what comes before the first: a fit
        of three iterations less a fit of one."""
        one, three = (timed(lambda n=n: tr.vectors_of(fit(docs, iters=n, prep=prepared[0]))) for n in (1, 3))
        return round((three - one) / 2, 3), round(one - (three - one) / 2, 3)

    headline = {"tfidf": q_tfidf, "vocabulary": q_vocabulary, "cooccurrence": q_cooccurrence,
                "hs_gradient": q_hs_gradient, "prepare_training": q_prepare, "nearest": q_nearest, "analogy": q_analogy}

    # warm the JVM once so the first query does not pay for class loading
    tfo.doc_count(docs).collect()
    results = {k: timed(fn) for k, fn in headline.items()}
    results["sync_iteration"], results["sync_setup"] = iteration(tr.fit_sync)
    results["local_sgd_iteration"], results["local_sgd_setup"] = iteration(tr.fit_local)

    context = {}
    if os.environ.get("BENCH_SKIP_MLLIB") != "1":
        from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, Word2Vec

        def mllib_tfidf():
            tok = RegexTokenizer(inputCol="text", outputCol="words", gaps=True,
                                 pattern=r"""[ \t\n.,()'":;!?<>]""", toLowercase=False)
            words = tok.transform(docs.select("doc_id", F.translate(
                "text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("text")))
            tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 20).transform(words)
            return IDF(inputCol="tf", outputCol="tfidf").fit(tf).transform(tf)

        context["mllib_tfidf"] = timed(mllib_tfidf)
        t = time.time()
        sent = docs.select(tokenize(F.col("text"), "C").alias("words"))
        Word2Vec(vectorSize=tr.DIM, minCount=9, windowSize=4, maxIter=1, numPartitions=int(cpus),
                 inputCol="words", seed=1).fit(sent)
        context["mllib_word2vec_1iter"] = round(time.time() - t, 3)

    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "context": context,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
