import numpy as np
import pytest
from edge import empty_documents, hard_documents
from pyspark.sql import functions as F

from wordloom.llm import language_id as lid
from wordloom.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return lid.train(docs)


# -------------------------------------------------------------------- language

def test_held_out_accuracy(docs, model):
    got = lid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    held = got[got.held_out]
    assert 0.25 < len(held) / len(got) < 0.42
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all() and held.score.mean() > 0.95


def test_nothing_is_learned_from_the_held_out_third(docs, model):
    changed = docs.withColumn("lang", F.when(lid.is_held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))) \
        .withColumn("text", F.when(lid.is_held_out(F.col("doc_id")), F.lit("zzz qqq")).otherwise(F.col("text"))) \
        .withColumn("source", F.lit("other"))
    again = lid.train(changed)
    assert again.languages == model.languages and np.array_equal(again.weights, model.weights)
    assert again.temperature == model.temperature


def test_weights_are_sparse_and_temperature_calibrates(model):
    assert 0 < (model.weights != 0).mean() < 0.6
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert lid.fit_temperature(logits * 3, y) == pytest.approx(3, rel=0.15)


def test_ngram_counts_against_plain_count():
    text = "Ab  ba\nß日"
    at, n = lid.ngram_counts(text)
    c = " ab ba ß日 "
    assert n.sum() == sum(len(c) - k for k in range(3)) and list(at) == sorted(set(at))
    assert lid.ngram_counts("")[1].sum() == 3 and lid.ngram_counts("ab ab")[1].max() >= 2


def test_language_of_hard_rows(spark, model):
    docs = hard_documents(spark)
    rows = lid.predict(docs, model).collect()
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        letters = any(map(str.isalpha, text[r.doc_id] or ""))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and r.held_out is not None
    kept = lid.keep_identified(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)
    assert lid.predict(empty_documents(spark), model).count() == 0


def test_training_on_little(spark):
    docs = hard_documents(spark)
    one = lid.train(docs)          # one language, one row dozens of times longer than the rest
    assert one.languages == ["en"] and one.predict("word")[0] == "en"
    none = lid.train(empty_documents(spark))
    assert none.predict("word") == ("und", 0.0)


# --------------------------------------------------------------------- quality

def test_quality_on_labels_not_fitted(docs, labels):
    fit = labels.filter("crc32(cast(doc_id as string)) % 2 = 0")
    test = labels.filter("crc32(cast(doc_id as string)) % 2 = 1")
    model = qc.train(docs, fit)
    got = qc.score(docs, model).join(test, "doc_id").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.97
    assert got[got.quality == 1].kept.mean() > 0.98
    assert model.passed[0] > 0                    # the sure view teaches the other


def test_toxic_documents_not_fitted_are_rejected_in_every_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    part = F.crc32(F.col("doc_id").cast("string")) % 2
    told = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    model = qc.train(docs, labels.filter(part == 0))
    got = qc.score(told, model, toxicity=True).join(labels.filter(part == 1), "doc_id") \
        .join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    good = got[got.quality == 1]
    print("passed on", model.passed, model.toxic.passed, "pieces", len(model.toxic.pieces))
    print(good.groupby(["lang", "toxic"], dropna=False).kept.agg(["size", "sum"]))
    toxic, clean = good[good.toxic == 1], good[good.toxic == 0]
    assert (~toxic.kept).mean() > 0.93 and clean.kept.mean() > 0.98
    assert (~toxic.kept).groupby(toxic.lang).mean().min() > 0.85
    assert (got.kept == ((got.quality == 1) & (got.toxic == 0))).mean() > 0.97


def test_word_pieces_and_shares_against_plain_counts():
    texts = ["Bomentera bomentes ab ab abc\nbomentera", "", None, "ß ßß\ud800x ßß\ud800x", "idiot " * 3 + "word " * 500]
    got = [qc.word_pieces(t) for t in texts]
    chosen = np.unique(np.concatenate([qc.pieces_of(w) for w in ("bomentera", "ab", "ßß\ud800x", "idiot", "unseen")]))
    shares = qc.piece_shares(texts, chosen)
    for t, (at, k, n), row in zip(texts, got, shares):
        words = qc.WORD.findall((t or "").lower())
        plain = {}
        for w in words:
            for p in qc.pieces_of(w):
                plain[p] = plain.get(p, 0) + 1
        assert n == len(words) and dict(zip(at.tolist(), k.tolist())) == plain and list(at) == sorted(plain)
        assert np.allclose(row, [np.log1p(100 * plain.get(p, 0) / (n + 50)) for p in chosen.tolist()])
    evidence = qc.Evidence(got)
    places = np.flatnonzero(np.isin(evidence.hashes, chosen))
    assert np.allclose(evidence.shares(places), shares[:, np.isin(chosen, evidence.hashes)])


def test_exact_tail_and_newton_fit_against_plain_programs():
    from fractions import Fraction
    from math import comb
    for k, n, p in ((0, 5, .3), (3, 7, .118), (31, 62, .118), (40, 40, .5), (1, 1, .01)):
        q = Fraction(p)
        exact = float(sum(comb(n, i) * q ** i * (1 - q) ** (n - i) for i in range(k, n + 1)))
        assert qc.binomial_tail(np.array([k]), np.array([n]), p)[0] == pytest.approx(exact, rel=1e-9)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    weight = rng.uniform(0.5, 2, 200)
    fit = qc.fit_logistic(x, y, weight)
    # the slope of the penalised log loss, row by row, vanishes
    slope = [qc.RIDGE * w for w in fit.weights[:-1]] + [0.0]
    for row, label, w in zip(x, y, weight):
        z = [(v - m) / s for v, m, s in zip(row, fit.mean, fit.scale)] + [1.0]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(z, fit.weights))))
        slope = [g + w * (p - label) * a for g, a in zip(slope, z)]
    assert max(map(abs, slope)) < 1e-2


def test_rows_are_passed_on_only_where_kept_rows_bear_it_out():
    def plain(p, right, weight):
        from math import comb
        best, base = np.inf, sum(right) / len(right)
        for cut in sorted(set(p)):
            at = [i for i in range(len(p)) if p[i] >= cut]
            k, n = sum(right[i] for i in at), len(at)
            tail = sum(comb(n, i) * base ** i * (1 - base) ** (n - i) for i in range(int(k), n + 1))
            if sum(weight[i] * right[i] for i in at) >= qc.SURE * sum(weight[i] for i in at) and tail <= qc.CHANCE:
                best = min(best, cut)
        return best
    rng = np.random.default_rng(4)
    for signal in (0.0, 1.0, 3.0):
        right = rng.integers(0, 2, 80).astype(float)
        p = np.round(1 / (1 + np.exp(-signal * (2 * right - 1) - rng.normal(size=80))), 2)
        weight = rng.uniform(0.5, 2, 80)
        assert qc.sure_from(p, right, weight) == plain(p.tolist(), right.tolist(), weight.tolist())
    assert qc.sure_from(np.full(100, 0.9), np.ones(100), np.ones(100)) == np.inf     # no better than chance


def test_evidence_chooses_as_a_plain_program():
    from math import comb
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"], 6)) + (" vile vile" if i % 5 == 0 else "") for i in range(120)]
    bad = np.array([i % 5 == 0 for i in range(100)], dtype=float)
    rows = np.arange(100)
    evidence = qc.Evidence([qc.word_pieces(t) for t in texts])
    expected = set()
    counts = [dict(zip(*[v.tolist() for v in qc.word_pieces(t)[:2]])) for t in texts]
    pieces = {p for c in counts for p in c}
    for p in pieces:
        for times in (1, 2):
            held = [i for i in range(100) if counts[i].get(p, 0) >= times]
            k, n, q = int(sum(bad[i] for i in held)), len(held), 0.2
            tail = sum(comb(n, i) * q ** i * (1 - q) ** (n - i) for i in range(k, n + 1))
            if k > 1 and k > q * n and tail * 2 * len(pieces) <= qc.WORD_RISK:
                expected.add(p)
    got = set(evidence.hashes[evidence.choose(rows, bad)].tolist())
    assert got == expected == set(qc.pieces_of("vile"))


def test_a_view_without_information_passes_nothing_wrong_on():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 900).astype(float)
    good = np.column_stack([y * 4 + rng.normal(size=900), rng.normal(size=(900, 2))]).astype(np.float32)
    noise = rng.normal(size=(900, 3)).astype(np.float32)
    truth = rng.integers(0, 2, 800).astype(float)
    pool = [np.column_stack([truth * 4 + rng.normal(size=800), rng.normal(size=(800, 2))]).astype(np.float32),
            rng.normal(size=(800, 3)).astype(np.float32)]
    model = qc.co_train([good, noise], y, np.ones(900), pool)
    assert model.passed[0] > 0 and model.passed[1] == 0
    assert ((model.score(*pool) >= 0.5) == truth).mean() > 0.95


def test_two_informative_views_teach_each_other():
    rng = np.random.default_rng(2)
    y, truth = (rng.integers(0, 2, n).astype(float) for n in (90, 3000))
    views = [[(t[:, None] * 5 + rng.normal(size=(len(t), 3))).astype(np.float32) for _ in (0, 1)] for t in (y, truth)]
    model = qc.co_train(views[0], y, np.ones(90), views[1])
    assert min(model.passed) > 0
    assert ((model.score(*views[1]) >= 0.5) == truth).mean() > 0.97


def test_quality_of_hard_rows_and_few_labels(spark, docs, labels):
    hard = hard_documents(spark)
    model = qc.train(docs, labels)
    rows = qc.score(hard, model).collect()
    assert len(rows) == hard.count() and all(0 <= r.quality_score <= 1 for r in rows)
    kept = qc.keep_good(hard, model)
    assert kept.columns == hard.columns and kept.count() == sum(r.kept for r in rows)
    assert qc.score(empty_documents(spark), model).count() == 0
    schema = "doc_id bigint, quality int"
    for given, share in (([], 1.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0), ([(1, None), (None, 0)], 1.0)):
        constant = qc.train(hard, spark.createDataFrame(given, schema))
        assert {r.quality_score for r in qc.score(hard, constant).collect()} == {share}
    assert qc.train(empty_documents(spark), labels).constant == 1.0
