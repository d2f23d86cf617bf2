"""What a task of training holds is bounded, and split work gives the same rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from wordloom.operators import located
from wordloom.operators import skipgram as sg
from wordloom.operators import train as tr

WORDS = ["w%d" % (i * i % 37) for i in range(400)]
ROWS = [(i, " ".join(WORDS[i * 9:i * 9 + 5 + i % 30])) for i in range(40)]


@pytest.fixture(scope="module")
def prep(spark):
    return tr.prepare(spark.createDataFrame(ROWS, "doc_id int, text string"), min_count=0, max_freq=2.0)


def peak(job):
    tracemalloc.start()
    try:
        job()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_cutting_tokens_takes_few_bytes_a_character():
    """Two cumulated sums of 8 bytes a character stood beside the text."""
    texts = pa.array([" ".join(WORDS * 20)] * 40)
    size = sum(len(t.as_py()) for t in texts)
    assert peak(lambda: located.tokens_of(texts, "C")) < 16 * size
    assert located.CHUNK_BYTES <= 8 << 20


def test_counting_pairs_takes_few_bytes_a_pair():
    """Both words of a pair were kept, searched and sorted apart, over 100 bytes a pair."""
    rnd = np.random.default_rng(1)
    keys = (rnd.integers(0, 3000, 200_000) << sg.ID_BITS) | rnd.integers(3000, 9000, 200_000)
    assert peak(lambda: [b.num_rows for b in sg.packed_parts(*counted(keys.copy()), 8)]) < 100 * len(keys)


def counted(keys):
    keys, n = sg.run_lengths(keys)
    return keys >> sg.ID_BITS, keys & sg.LOW, n


@pytest.mark.parametrize("part_pairs, slice_pairs", [(1 << 18, 1 << 22), (40, 1 << 22), (40, 16), (1, 5)])
def test_counts_of_any_parts_and_slices_are_the_pairs(prep, monkeypatch, part_pairs, slice_pairs):
    """Words are put together part by part, however many there are."""
    monkeypatch.setattr(sg, "PART_PAIRS", part_pairs)
    monkeypatch.setattr(sg, "SLICE_PAIRS", slice_pairs)
    want, total = {}, 0
    for r in prep.docs.collect():
        for i, x in enumerate(r["ids"]):
            for j, y in enumerate(r["ids"]):
                if i != j and abs(r["pos"][i] - r["pos"][j]) <= 4:
                    want[x, y] = want.get((x, y), 0) + 1
                    total += 1
    cooc = tr.cooccurrence(prep)
    assert {(r["id"], r["context"]): r["n"] for r in cooc.collect()} == want
    rows = cooc._lists.collect()
    assert {r["part"] for r in rows} <= set(range(cooc._lists._parts)) and cooc._lists._parts >= total / part_pairs
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in sorted(rows, key=lambda r: r["part"])])
    held = list(sg.words_of([batch]))
    assert len(held) == len({r["part"] for r in rows}) and sum(len(ids) for ids, *_ in held) == len(want)


def test_slices_of_one_number_are_refused(spark):
    docs = spark.createDataFrame([([0, 1], [1, 1 << 31])], "pos array<bigint>, ids array<bigint>")
    with pytest.raises(Exception, match="numbered from 0"):
        sg.cooccurrence_of_ids(docs).collect()


def test_codes_follow_from_the_numbers(spark, prep):
    """No join brings every pair its context's code."""
    table = tr.code_table(prep.words)
    for r in prep.words.collect():
        code, size = tr.codes_of(np.array([r["id"]]), table)
        assert (code[0], size[0]) == (r["code"], r["len"])
    targets = tr.word_targets(tr.cooccurrence(prep), prep.words)
    assert "Join" not in targets._jdf.queryExecution().executedPlan().toString()
    other = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 2, 0)], "id bigint, len int, code bigint")
    with pytest.raises(ValueError, match="canonical"):
        tr.code_table(other)


@pytest.mark.parametrize("contexts", [1, 7, 1 << 16])
def test_cells_are_folded_from_counts(spark, prep, monkeypatch, contexts):
    """Cells take the counts, fold them in slices, and hold
    numbers of 4 bytes; targets are not written first. So do rows of other origin."""
    monkeypatch.setattr(tr, "SLICE_CONTEXTS", contexts)
    monkeypatch.setattr(tr, "CELL_ENTRIES", 50)
    targets = tr.word_targets(tr.cooccurrence(prep), prep.words)
    want = sorted(map(tuple, tr.node_targets(targets).collect()))
    entries, top = tr.target_sizes(targets._source[0], targets._source[0]._parts, targets._source[1])
    assert entries == len(want) and top == max(n for _, _, n, _ in want)
    asked = []
    monkeypatch.setattr(tr, "written", lambda df, name, was=tr.written: (asked.append(name), was(df, name))[1])
    own = tr.cells(targets, prep.words.count())
    assert "targets" not in asked
    other = tr.cells(spark.createDataFrame(targets.collect(), targets.schema), prep.words.count())
    for work in (own, other):
        assert {f.dataType.simpleString() for f in work.rows.schema if f.name in "abc"} == {"array<int>"}
        assert sorted((r["id"], *t) for r in work.rows.collect() for t in zip(r["a"], r["b"], r["c"])) == want
        work.drop()


def test_nodes_are_added_up_in_between(monkeypatch):
    """Errors of rare nodes are not kept to the end of a cell."""
    rnd = np.random.default_rng(4)
    met = [np.sort(rnd.permutation(60)[:20]) + 1 for _ in range(50)]
    n = [rnd.integers(1, 5, 20) for _ in met]
    lists = [pa.array([x.tolist() for x in some], pa.list_(pa.int32())) for some in (met, n, n)]
    work = pa.table([pa.array(np.arange(50)), *lists], names=["id", "a", "b", "c"])
    keys, asked = np.concatenate([np.arange(-60, 0), np.arange(50)]), []
    base = rnd.normal(0, 1, (len(keys), 6))
    monkeypatch.setattr(tr, "TILE_WORDS", 4)
    monkeypatch.setattr(tr, "TILE_DENSITY", 9.0)
    shards = []
    for most in (1 << 18, 100):
        monkeypatch.setattr(tr, "SLICE_ENTRIES", most)
        monkeypatch.setattr(tr, "by_nodes", lambda shard, rest, was=tr.by_nodes: (asked.append(sum(len(x) for x, _, _ in rest)), was(shard, rest)))
        shards.append(tr.Shard(keys, base))
        tr.gradient_kernel(shards[-1], work)
    assert asked[0] == 1000 and max(asked[1:]) < 300
    assert np.allclose(shards[0].change, shards[1].change, atol=1e-12) and (shards[0].n == shards[1].n).all()


def test_names_come_to_the_counts(spark, prep, monkeypatch):
    """Targets joined with the words were exchanged; now only packed counts and names are."""
    monkeypatch.setattr(sg, "PART_PAIRS", 40)
    cooc = tr.cooccurrence(prep)
    targets = tr.word_targets(cooc, prep.words, named=True)
    plan = targets._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "nodes" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
    names = {r["id"]: r["word"] for r in prep.words.collect()}
    got = {r["id"]: r for r in targets.collect()}
    assert {i: r["word"] for i, r in got.items()} == {i: w for i, w in names.items() if i in got}
    plain = {r["id"]: (r["nodes"], r["n"], r["n1"]) for r in tr.word_targets(cooc, prep.words).collect()}
    assert plain == {i: (r["nodes"], r["n"], r["n1"]) for i, r in got.items()}


def test_contexts_that_come_twice_are_folded_once():
    code, size, n = np.array([0, 2, 3, 2]), np.array([1, 2, 2, 2]), np.array([1, 2, 3, 4])
    for order in ([0, 1, 2, 3], [3, 2, 1, 0]):
        got = {int(v): (int(a), int(b)) for v, a, b in zip(*tr.fold(code[order], size[order], n[order]))}
        assert got == {1: (10, 1), 3: (9, 6)}


ODD = [(1, "red fox, red hen; a fox"), (2, ""), (4, "hen"), (5, "unknown words only"), (6, "fox " * 40 + "x y z w v hen red"),
       (7, "Red\nHEN a fox a b c d e f red"), (8, "red red red")]


@pytest.mark.parametrize("size", [1 << 23, 16])
def test_tokens_stay_in_their_chunks(spark, monkeypatch, size):
    """Tokens were exchanged by word and again by document; now the text and a chunk's distinct words are."""
    monkeypatch.setattr(located, "CHUNK_BYTES", size)
    docs = spark.createDataFrame(ODD, "doc_id int, text string")
    vocab = spark.createDataFrame([("red",), ("fox",), ("hen",), ("absent",)], "word string")
    pairs, windows = sg.skipgram_pairs(docs, vocab), sg.skipgram_windows(docs, vocab)
    want = []
    for i, text in ODD:
        words = text.lower().replace(",", " ").replace(";", " ").split()
        want += [(i, x, y, words[x], words[y]) for x in range(len(words)) for y in range(max(0, x - 4), min(len(words), x + 5))
                 if x != y and {words[x], words[y]} <= {"red", "fox", "hen"}]
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    assert sorted((r["doc_id"], r["pos"], p, r["word"], c) for r in windows.collect() for p, c in zip(r["context_pos"], r["context"])) == sorted(want)
    for df in (pairs, windows):
        keys = [x.split("hashpartitioning(")[1].split("#")[0] for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hash" in x]
        assert keys.count("chunk") >= 2 and "doc_id" not in keys
