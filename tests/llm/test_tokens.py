import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from edge import TEXTS, empty_documents, hard_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from wordloom.llm import bpe, packing, token_counts, token_files
from wordloom.llm.queries import op4_token_counts, op7_token_files, op10_packing
from wordloom.session import scratch_path

SF = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
FILES = {f: Tokenizer.from_file(f) for f in (WORD, BYTE)}
for _t in FILES.values():
    _t.encode_special_tokens = True


def ids_of(path, text):
    return FILES[path].encode(text or "", add_special_tokens=False).ids


def batched(path, texts):
    ids, offsets = bpe.encode_texts(path, pa.array(texts, pa.large_string()))
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_batched_ids_equal_the_library(path):
    texts = [t or "" for t in TEXTS]
    assert batched(path, texts) == [ids_of(path, t) for t in texts]
    assert batched(path, texts[7:9]) == [ids_of(path, t) for t in texts[7:9]]
    assert batched(path, []) == [] and batched(path, ["", ""]) == [[], []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé×Ł́   \n\t.1,テA", max_size=14), max_size=4))
def test_batched_ids_equal_the_library_on_random_text(texts):
    for path in (WORD, BYTE):
        assert batched(path, texts) == [ids_of(path, t) for t in texts]


def test_ids_do_not_depend_on_the_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(bpe, "_encoders", {})
    texts = ["alpha beta gamma delta", "beta epsilon", "alpha zeta beta eta"] * 3
    assert batched(BYTE, texts) == [ids_of(BYTE, t) for t in texts]


# ------------------------------------------------------------------ counts

@pytest.fixture(scope="module")
def unigram():
    v = token_counts.load_vocabulary(PIECE)
    vocab = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *v.scores.items()]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


def test_counts_equal_the_unigram_library(spark, unigram):
    got = op4_token_counts(spark, SF).toPandas().set_index("doc_id").n_tokens
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {i: len(unigram.encode(t).ids) for i, t in text.items()} == got.to_dict()


def test_counts_of_hard_rows(spark, unigram):
    docs = hard_documents(spark)
    got = token_counts.count_tokens(docs, PIECE)
    want = sorted((r.doc_id is None, r.doc_id, len(unigram.encode(r.text).ids) if r.text else 0) for r in docs.collect())
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in got.collect()) == want
    assert token_counts.count_tokens(empty_documents(spark), PIECE).count() == 0


def test_marks_in_texts_are_spaces_to_the_pieces(unigram):
    """U+2581 in a text joins the marks around it, as in the library."""
    c = token_counts.Counter(token_counts.load_vocabulary(PIECE))
    assert c.by_stretch
    rnd = random.Random(9)
    texts = ["▁▁ ▁", "x▁ ▁ y", "a▁   b", "▁", " ▁ ", "a▁b"]
    texts += ["".join(rnd.choice("ab  ▁▁\n1é") for _ in range(rnd.randint(1, 25))) for _ in range(3000)]
    assert c.texts(pa.array(texts, pa.large_string())).tolist() == [len(unigram.encode(t).ids) for t in texts]


def brute_count(v, text):
    """Every segmentation's score by a plain program over (score, pieces)."""
    n = len(text)
    best = [(0.0, 0)] + [None] * n
    for e in range(1, n + 1):
        for s in range(e):
            if text[s:e] in v.scores:
                score = best[s][0] + v.scores[text[s:e]]
                if best[e] is None or score > best[e][0]:
                    best[e] = (score, best[s][1] + 1)
        c = text[e - 1]
        if c not in v.scores:
            score = best[e - 1][0] + v.lowest - 10
            if best[e] is None or score > best[e][0]:
                best[e] = (score, best[e - 1][1] + len(c.encode()))
    return best[n][1]


def test_viterbi_against_plain_program_with_ties_and_fractions():
    rnd = random.Random(3)
    for scores in ([-1.0, -2.0, -3.0], [-1.0, -1.0, -1.0], [-0.3, -1.7, -2.25]):
        pieces = {"".join(rnd.choice("ab▁") for _ in range(rnd.randint(1, 3))): rnd.choice(scores) for _ in range(14)}
        v = token_counts.Vocabulary(pieces, True, min(scores))
        c = token_counts.Counter(v)
        for _ in range(200):
            text = "".join(rnd.choice("ab▁c") for _ in range(rnd.randint(1, 9)))
            assert c.count(text) == brute_count(v, text)
        texts = ["a b", " ab  ba ", "", "c  c"]
        assert c.texts(pa.array(texts, pa.large_string())).tolist() == [
            brute_count(v, (" " + t).replace(" ", "▁")) if t else 0 for t in texts]


# ------------------------------------------------------------------- files

def check_files(rows, docs):
    """``rows``: (id, start, n, crc) in file order; ``docs``: (id, text) in that order."""
    start = 0
    for r, (i, text) in zip(rows, docs, strict=True):
        ids = np.array([*ids_of(WORD, text), 1], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_files_round_trip(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    check_files(sorted(op7_token_files(spark, SF).collect(), key=lambda r: r.start), docs)


def test_files_over_many_partitions_and_hard_rows(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 7)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        docs = hard_documents(spark)
        folder = scratch_path(spark, "files")
        manifest = token_files.write_token_files(docs, folder, WORD, 1)
        assert manifest.count() > 3 and {r.width for r in manifest.collect()} == {2}
        rows = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
        want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
        check_files(rows, want)
        # a repeated run of a task leaves the same files
        again = token_files.write_token_files(docs, folder, WORD, 1)
        check_files(sorted(token_files.read_token_files(again).collect(), key=lambda r: r.start), want)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    empty = token_files.write_token_files(empty_documents(spark), scratch_path(spark, "files"), WORD, 1)
    assert token_files.read_token_files(empty).count() == 0


# ----------------------------------------------------------------- packing

def check_packed(pdf, docs, path=BYTE, capacity=2048):
    """Whole documents, gapless sequences, right checksums."""
    assert len(pdf) and pdf.groupby("sequence_id").length.sum().max() <= capacity
    assert sorted(pdf.sequence_id.unique()) == list(range(pdf.sequence_id.nunique()))
    by_seq = pdf.sort_values(["sequence_id", "offset"])
    assert (by_seq.offset == by_seq.groupby("sequence_id").length.cumsum() - by_seq.length).all()
    want = []
    for i, text in docs:
        ids = np.array([*ids_of(path, text), 1], dtype="<u4")
        want += [(-1 if i is None else i, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes()), len(ids))
                 for a in range(0, len(ids), capacity)]
    got = pdf.fillna({"doc_id": -1})[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype("int64")
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(want)


def test_packing_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pdf = op10_packing(spark, SF).toPandas()
    check_packed(pdf, docs)
    assert 1 - pdf.length.sum() / 2048 / pdf.sequence_id.nunique() < 0.03


def test_equal_rows_spread_over_packers(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_PACKER", 50)
    docs = spark.createDataFrame([(None, "one and the same text")] * 900, "doc_id bigint, text string").repartition(3)
    cut = packing.pieces(docs, BYTE, 1, 2048, "doc_id", "text")
    assert cut.select("salt").distinct().count() == 900
    rows = packing.pack(docs, BYTE, 1).collect()
    assert len(rows) == 900
    deal = cut.groupBy((F.pmod(F.xxhash64("doc", "start", "ids_crc32", "salt"), F.lit(18))).alias("g")).count().collect()
    assert len(deal) == 18 and max(r["count"] for r in deal) < 100


def test_packing_hard_rows_and_many_packers(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_PACKER", 4)
    docs = hard_documents(spark)
    check_packed(packing.pack(docs, BYTE, 1, capacity=64).toPandas(), [(r.doc_id, r.text) for r in docs.collect()], capacity=64)
    assert packing.pack(empty_documents(spark), BYTE, 1).count() == 0


def test_sum_of_squares_against_plain_loop():
    rnd = random.Random(5)
    for capacity in (6, 10, 33):
        sizes = [rnd.randint(1, capacity - 1) for _ in range(300)]
        window, offset, left = packing.sum_of_squares(np.array(sizes), capacity)
        fills, count = [], [0] * (capacity + 1)
        for i, s in enumerate(sizes):
            options = []
            for h in range(capacity - s, -1, -1):
                if h == 0 or count[h]:
                    after = count.copy()
                    after[h] -= h > 0
                    after[h + s] += h + s < capacity
                    options.append((sum(c * c for c in after), -h))
            h = -min(options)[1]
            if h:
                w = max((w for w in range(len(fills)) if fills[w][0] == h), key=lambda w: fills[w][1])
            else:
                w = len(fills)
                fills.append([0, 0])
            count[h] -= h > 0
            fills[w] = [h + s, i]
            count[h + s] += h + s < capacity
            assert (window[i], offset[i]) == (w, h)
        assert sorted(left) == [w for w, f in enumerate(fills) if f[0] < capacity]


def test_windows_left_open_go_through_the_same_rule_again():
    rnd = random.Random(6)
    for capacity, n in ((10, 200), (2048, 1000), (33, 1)):
        sizes = np.array([rnd.randint(1, capacity - 1) for _ in range(n)])
        window, offset, _ = packing.sum_of_squares(sizes, capacity)
        again, place = packing.place_again(sizes, window, offset, capacity)
        assert sorted(set(again)) == list(range(again.max() + 1)) and again.max() <= window.max()
        for w in range(again.max() + 1):
            at = sorted(np.flatnonzero(again == w), key=lambda i: place[i])
            assert [place[i] for i in at] == [sum(sizes[at[:j]]) for j in range(len(at))] and sizes[at].sum() <= capacity
        full = np.bincount(window, sizes)[window] == capacity
        assert (offset[full] == place[full]).all()
