import random

import numpy as np
from edge import LONG, empty_documents, hard_documents

from wordloom.llm import decontaminate as dc
from wordloom.llm.queries import op8_decontamination

SF = "/root/testdata/sf0.01"
ITEM = "the quick brown fox jumps over a lazy dog while seven green parrots watch from an old oak tree nearby"


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def found(spark, docs, items, **kw):
    items = frame(spark, items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in dc.contaminated(frame(spark, docs), items, **kw).collect()}


def filler(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(n))


def test_copies_and_edits_are_found(spark):
    w = ITEM.split()
    edited = " ".join(x if i % 7 != 3 else "changed" for i, x in enumerate(w))
    shorter = " ".join(x for i, x in enumerate(w) if i not in (5, 12))
    longer = " ".join(x + (" extra" if i % 6 == 2 else "") for i, x in enumerate(w))
    docs = [(1, ITEM), (2, f"{filler(1, 300)} {ITEM.upper()}! {filler(2, 300)}"), (3, f"{filler(3, 40)} {edited} {filler(4, 9)}"),
            (4, f"{filler(5, 40)} {shorter}"), (5, f"{longer} {filler(6, 40)}"), (6, filler(7, 800)),
            (7, "the quick brown fox " + filler(8, 300)), (8, None), (9, "")]
    got = found(spark, docs, [(70, ITEM), (71, filler(99, 30)), (72, None), (73, "too short"), (74, "!!!")])
    assert set(got) == {(i, 70) for i in (1, 2, 3, 4, 5)}
    assert got[1, 70].score == 1.0 and got[2, 70].score == 1.0
    assert (got[2, 70].first_word, got[2, 70].last_word) == (300, 300 + len(w) - 1)
    assert all(0.5 <= got[i, 70].score < 1 for i in (3, 4, 5))


def test_an_item_repeated_everywhere_is_still_found(spark):
    docs = [(i, f"{filler(i, 20)} {ITEM} {filler(-i, 20)}") for i in range(300)]
    assert set(found(spark, docs, [(1, ITEM)])) == {(i, 1) for i in range(300)}


def test_several_blocks_give_the_same(spark, monkeypatch):
    docs = [(i, f"{filler(i, 30)} {filler(1000 + i % 7, 25)}") for i in range(40)]
    items = [(i, filler(1000 + i, 25)) for i in range(7)]
    one = {k: v.score for k, v in found(spark, docs, items).items()}
    monkeypatch.setattr(dc, "SLICE_BYTES", 900)
    assert one == {k: v.score for k, v in found(spark, docs, items).items()}
    monkeypatch.setattr(dc, "BLOCK_CHARS", 300)
    assert one == {k: v.score for k, v in found(spark, docs, items).items()}
    assert len(one) == 40


def test_alignment_against_plain_program():
    rnd = random.Random(2)
    for _ in range(200):
        a = np.array([rnd.randint(0, 4) for _ in range(rnd.randint(1, 12))])
        b = np.array([rnd.randint(0, 4) for _ in range(rnd.randint(0, 15))], dtype=np.int64)
        h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                s = dc.MATCH if a[i] == b[j] else dc.MISMATCH
                h[i + 1, j + 1] = max(0, h[i, j] + s, h[i, j + 1] + dc.GAP, h[i + 1, j] + dc.GAP)
        assert dc.align(a, b)[0] == h.max()


EDITS = {
    "whole": lambda w, f: w,
    "every 3rd changed": lambda w, f: [f() if i % 3 == 2 else x for i, x in enumerate(w)],
    "every 4th changed": lambda w, f: [f() if i % 4 == 1 else x for i, x in enumerate(w)],
    "every 3rd left out": lambda w, f: [x for i, x in enumerate(w) if i % 3 != 1],
    "one put after every 2nd": lambda w, f: [y for i, x in enumerate(w) for y in ([x, f()] if i % 2 else [x])],
    "one put after each": lambda w, f: [y for x in w for y in (x, f())],
    "two put after every 3rd": lambda w, f: [y for i, x in enumerate(w) for y in ([x, f(), f()] if i % 3 == 2 else [x])],
    "first half": lambda w, f: w[:(len(w) + 1) // 2],
    "halves apart": lambda w, f: w[:len(w) // 2] + [f() for _ in range(len(w) // 3)] + w[len(w) // 2:],
}


def test_every_edit_that_aligns_is_found(spark):
    """Against a full alignment of every item with every document: none that
    reaches the score is missed, whatever the pattern."""
    rnd = random.Random(11)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:25]
    pool = " ".join(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()).split()

    def foreign():
        return rnd.choice(pool)
    rows = []
    for edit in EDITS.values():
        for item, text in items:
            words = edit(text.split(), foreign)
            rows.append(([foreign() for _ in range(60)] + words + [foreign() for _ in range(60)], item))
    for _ in range(60):
        item, text = rnd.choice(items)
        words = [x for w in text.split() for x in rnd.choice([[w], [w], [w], [foreign()], [], [w, foreign()]])]
        rows.append(([foreign() for _ in range(60)] + words + [foreign() for _ in range(60)], item))
    docs = frame(spark, [(i, " ".join(w)) for i, (w, _) in enumerate(rows)])
    got = {(r.doc_id, r.item_id): r.score for r in dc.contaminated(docs, frame(spark, items, "item_id bigint, text string")).collect()}
    index = dc.make_index(items)
    n = 0
    for i, (words, planted) in enumerate(rows):
        ids, _ = dc.word_ids(dc.texts_of(dc.pa.array([" ".join(words)])), index.known)
        for item, word in zip(index.item_ids, index.words):
            if item != planted and i % 10:
                continue
            score = dc.align(word, ids)[0] / (dc.MATCH * len(word))
            assert ((i, item) in got) == (score >= 0.5), (i, item, score)
            if score >= 0.5:
                assert got[i, item] == score
                n += 1
    assert n > 200


def test_short_items_need_a_run(spark):
    items = [(1, "of the"), (2, "word"), (3, "the cat of the house"), (4, ITEM)]
    docs = [(1, "the end of time"), (2, "most of the time"), (3, "a word"), (4, "wordy"), (5, "the big cat of the big house"),
            (6, "the dog of a house"), (7, "house of the cat the")]
    got = {(d, i) for d, i in found(spark, docs, items)}
    assert got == {(2, 1), (3, 2), (5, 3), (5, 1), (7, 1)}


def test_table_against_whole_copies(spark):
    def norm(t):
        return " " + " ".join(dc.item_words(t)) + " "
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: norm(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id): r.score for r in op8_decontamination(spark, SF).collect()}
    assert whole and whole <= set(got) and {k for k, s in got.items() if s == 1.0} == whole


def test_hard_rows_and_clean_documents(spark):
    docs = hard_documents(spark)
    items = frame(spark, [(1, LONG[:300]), (2, "no id here")], "item_id bigint, text string")
    got = dc.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(20, 1), (None, 2)}
    clean = dc.clean_documents(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 2
    assert dc.contaminated(empty_documents(spark), items).count() == 0
    none = frame(spark, [], "item_id bigint, text string")
    assert dc.contaminated(docs, none).count() == 0 and dc.clean_documents(docs, none).count() == docs.count()
