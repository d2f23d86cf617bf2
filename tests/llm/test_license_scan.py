import random
import re
from collections import Counter

import duckdb
import pytest
from edge import empty_documents, hard_documents
from test_native_filters import plan_of

from wordloom.llm import license_scan as ls
from wordloom.llm import queries

SF = "/root/testdata/sf0.01"


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op12_license_scan"])
    df = queries.op12_license_scan(spark, SF)
    assert not any(x in plan_of(df) for x in ("Python", "Pandas", "Arrow"))
    assert Counter(map(tuple, df.select(*want.columns).collect())) == Counter(want.fetchall())


def brute(text, templates, phrases, threshold):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    starts = {label: [] for _, label in phrases}
    for phrase, label in phrases:
        p = phrase.split(" ")
        starts[label] += [i for i in range(len(words)) if words[i:i + len(p)] == p]
    base = {label for label, s in starts.items() if s}
    at = sorted(i for s in starts.values() for i in s)
    hits = set()
    for n, label, size, need, span, distinct in ls.template_rows(templates, threshold):
        for start in range(0, len(words), span):
            common = len(set(words[start:start + 2 * span]) & set(distinct))
            if common >= need:
                hits.add((start, n, label, common / size))
    found = {h[2] for h in hits}
    score = 1.0 if base else max([h[3] for h in hits], default=0.0)
    return (len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)),
            ",".join(sorted(base | found)), score), hits


TEXTS = [
    "All rights reserved. all RIGHTS\nreserved, cc-by cc by cc by-nc", "general public license general public license",
    "ccby general public licenses", "x" + " all rights reserved" * 3 + " y", "Kelvin: Kelvin all rightſ reserved",
    "É all rights reserved É", "all rights éreserved", "the " * 3000 + ls.TEMPLATES[2][1] + " the" * 3000,
    "Released under the MIT License.", "released under the license", "Licensed under CC BY-NC 4.0.", "cc by", "by cc",
    "…all rights reserved…", "reserved rights all all rights", "all\x00rights_reserved", "cc  by", "cc by cc",
]


def planted(rng, threshold):
    """Templates with words left out, moved and mixed with others."""
    out = []
    for _, text in ls.TEMPLATES:
        words = text.split(" ")
        for drop in (0, 1, 2, 3, 5):
            kept = [w for i, w in enumerate(words) if i not in set(rng.sample(range(len(words)), min(drop, len(words) - 1)))]
            if drop == 2:
                rng.shuffle(kept)
            around = [rng.choice(["foo", "bar", "the", "of", "license", "Ünder"]) for _ in range(rng.randrange(80))]
            out.append(" ".join(around + kept + around[:10]))
    return out


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_blocks_and_phrases_equal_brute_force(spark, threshold, monkeypatch):
    texts = TEXTS + planted(random.Random(2), threshold)
    docs = spark.createDataFrame([(i, t, "l", "r", 1, 2) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, label string, row string, n_words int, blocks int").unionByName(
        hard_documents(spark), allowMissingColumns=True)
    if threshold == 0.6:
        monkeypatch.setattr(ls, "MAX_BROADCAST_ROWS", 0)
    got, blocks = ls.scan(docs.drop("id", "score"), threshold=threshold)
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, brute(r.text, ls.TEMPLATES, ls.PHRASES, threshold)) for r in rows]
    assert Counter(map(tuple, got.collect())) == Counter((i, *w) for i, (w, _) in want)
    # equal documents give equal blocks, once each
    assert Counter(map(tuple, blocks.collect())) == Counter((i, *h) for i, (_, hits) in want for h in hits)
    assert sum(len(h) for _, (_, h) in want) > 40


def test_other_lists_and_empty_tables(spark):
    got, blocks = ls.scan(empty_documents(spark))
    assert not got.count() and not blocks.count()
    docs = spark.createDataFrame([(1, "all rights reserved")], "k int, t string")
    got, _ = ls.scan(docs, templates=[("none", "..."), ("short", "Rights")], phrases=[], id_col="k", text_col="t")
    assert [tuple(r) for r in got.collect()] == [(1, 3, 0, None, None, "", "short", 1.0)]
    got, _ = ls.scan(docs, templates=[], id_col="k", text_col="t")
    assert [tuple(r) for r in got.collect()] == [(1, 3, 1, 0, 0, "reserved", "reserved", 1.0)]
    with pytest.raises(ValueError, match="overlap"):
        ls.scan(docs, phrases=[("a b a", "x")], id_col="k", text_col="t")
