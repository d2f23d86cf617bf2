import corpus_pipeline as cp
from edge import empty_documents, hard_documents
from test_simhash import brute_components, brute_fingerprint
from test_tokens import check_packed

from wordloom.llm import decontaminate as dc
from wordloom.llm import language_id, quality_classifier

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    quality = quality_classifier.train(docs, labels)
    kept = [i for i, r in rows.items() if quality_classifier.judge(quality, [r.text], [r.source], [r.lang], [r.n_chars])[0]
            >= quality_classifier.KEEP]
    language = language_id.train(docs.filter(docs.doc_id.isin(kept)))
    kept = sorted(i for i in kept if (p := language.predict(rows[i].text))[0] != "und" and p[1] >= cp.MIN_LANGUAGE_SCORE)
    least = brute_components([brute_fingerprint(rows[i].text) for i in kept], 2)
    kept = [kept[i] for i in range(len(kept)) if least[i] == i]
    items = [" " + " ".join(dc.item_words(r.text)) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [i for i in kept if not any(x in " " + " ".join(dc.item_words(rows[i].text)) + " " for x in items)]
    out = cp.run(spark, SF).toPandas()
    check_packed(out, [(i, rows[i].text) for i in kept])
    assert 0.4 * len(rows) < len(kept) < len(rows)


def test_one_row_of_each_group_stays(spark):
    a, b = "one two three four five six seven", "quite another text that nobody has seen"
    rows = [(0, b, 1), (1, a, 2), (1, b, 3), (0, b, 4), (0, b, 5), (None, b, 6), (None, "nobody knows this third one at all", 7),
            (None, "nobody knows this third one at all", 8), (5, a, 9)]
    for clash in ("gone", "row_number", "member"):
        docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {clash} int").repartition(3)
        out = cp.near_duplicates(spark, docs, SF)
        assert out.columns == docs.columns
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect()))
        assert got == [(False, 0, b), (False, 1, a), (True, 0, "nobody knows this third one at all")]


def test_stages_in_order():
    assert [f for _, f in cp.STAGES] == [cp.quality, cp.language, cp.near_duplicates, cp.decontamination, cp.pack]


def test_stages_take_hard_and_empty_tables(spark):
    for docs in (hard_documents(spark), empty_documents(spark)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert cp.pack(spark, docs, SF).count() >= docs.count()
