import hashlib
import random
from collections import Counter

import pyarrow as pa
import public_tokenizers as P
import sentencepiece
from edge import empty_documents, hard_documents
from tokenizers import Tokenizer

from wordloom.llm import alignment as al
from wordloom.llm.common import table

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
HARD = ["a  b", "  x ", "\tq\n\nz ", "ﬁne Ａ é é", "▁▁ ▁", "x y　z", "nul\0x", " ", "\n", "\n\n a\n", "a\r\nb", "x" * 300,
        "<|endoftext|> <s> </s> <unk> <0x41>", "don't  stop\n  now", "日本語 テキスト", "🙂 🙂🙂", "a▁b", "a " * 200, "1,234.5 - --- ===="]


def plain(texts):
    """Whole texts given to both libraries, ends compared token by token."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    spell = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    spell |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in set(spell.values()))}
    name = {i: t for t, i in a.get_vocab().items()}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, links = [], []
    for text in texts:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        sa, sb = [bytes(spell[c] for c in name[i]) for i in ia], [piece(i) for i in ib]
        whole = (" " + text).encode() if text else b""
        if b"".join(sa) != whole or b"".join(sb) != whole or not text:
            out.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [[0], [0]]
        for side, s in zip(ends, (sa, sb)):
            for t in s:
                side.append(side[-1] + len(t))
        pos = [{e: k for k, e in enumerate(side)} for side in ends]
        shared = sorted(set(ends[0][1:]) & set(ends[1][1:]))
        groups, x, y = [], 0, 0
        for e in shared:
            i, j = pos[0][e], pos[1][e]
            groups.append(",".join(map(str, ia[x:i])) + "|" + ",".join(map(str, ib[y:j])))
            x, y = i, j
        links.append([(ia[pos[0][e] - 1], ib[pos[1][e] - 1]) for e in shared])
        out.append((len(ia), len(ib), len(groups), len(shared), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for doc in links for p in doc)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(*o, sum(count[p] == best[p[1]] for p in doc), sum(count[p] for p in doc)) for o, doc in zip(out, links)], count


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    want, _ = plain([r.text for r in rows])
    got = [tuple(r[c] for c in COLUMNS) for r in al.aligned_documents(docs, A, B).collect()]
    assert Counter(got) == Counter((r.doc_id, *w) for r, w in zip(rows, want))


def test_documents_equal_the_plain_program(spark):
    check(table(spark, SF, "documents").repartition(3))


def test_hard_rows_equal_the_plain_program(spark):
    rng = random.Random(4)
    alphabet = list("ab  \n\n\t.'éÄ▁z日🙂 ") + ["the ", " of", "ing", "\n\n", "  "]
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    docs = spark.createDataFrame([(i % 50, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, n_a int")
    check(docs.unionByName(hard_documents(spark).select("doc_id", "text", "k").withColumnRenamed("k", "n_a")))


def test_empty_table(spark):
    assert al.aligned_documents(empty_documents(spark), A, B).collect() == []


def test_pairs_hold_every_link_and_counts(spark):
    docs = table(spark, SF, "documents")
    held = al.aligner(A, B)
    _, count = plain([r.text for r in docs.collect()])
    counts = al.pair_counts(al.align(docs, A, B), len(held.pairs))
    got = {(r.a, r.b): (r.n, r.best) for r in al.alignment_table(counts, held.pairs).collect()}
    assert {p: n for p, (n, _) in got.items()} == count
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    assert all(b == (n == best[p[1]]) for p, (n, b) in got.items())


def test_runs_give_the_ids_of_whole_texts():
    rng = random.Random(6)
    texts = HARD + ["one two  three four five " * 9, " " * 40 + "x" + " " * 30, "a ", " ", "  ", "\n ", " \n", "\n\n", "nospaceatall" * 30]
    texts += ["".join(rng.choice(["a", " ", "  ", "\n", "▁", "the ", "é", "\r", "\t"]) for _ in range(80)) for _ in range(300)]
    texts = [t for t in texts if "▁" not in t]
    held = al.Aligner(A, B)
    assert held.cuts
    spaced = pa.array([" " + t for t in texts], pa.large_string())
    got = held.b_ids(spaced)
    held.cuts = False
    assert all((x == y).all() for x, y in zip(got, held.b_ids(spaced)))


def test_slices_change_nothing(spark, monkeypatch):
    docs = table(spark, SF, "documents").limit(60)
    want = sorted(map(tuple, al.align(docs, A, B).drop("links").collect()))
    monkeypatch.setattr(al, "SLICE_BYTES", 500)
    assert sorted(map(tuple, al.align(docs, A, B).drop("links").collect())) == want
