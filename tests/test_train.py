"""Training arithmetic against plain-Python loops, and learning on real text."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.functions.text import tokenize
from wordloom.operators import skipgram as sg
from wordloom.operators import train as tr
from wordloom.operators import vocab as vo
from wordloom.plans import catalog

SF001 = "/root/testdata/sf0.001"
DOCS = [
    (1, "the cat sat on the mat with hat"),
    (2, "a dog sat on a log with cat"),
    (3, "the dog and the cat on mat now"),
    (4, ""),
]
DIM = 3


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id int, text string")


@pytest.fixture(scope="module")
def small(spark, docs):
    """Every word kept; random parameters large enough to reach the clip."""
    prep = tr.prepare(docs, min_count=0, max_freq=2.0)
    rnd = random.Random(7)
    ids = {r["word"]: r["id"] for r in prep.words.collect()}
    path = {}
    for r in prep.paths.orderBy("id", "depth").collect():
        path.setdefault(r["id"], []).append((r["node"], r["label"]))
    wv = {i: [rnd.uniform(-3, 3) for _ in range(DIM)] for i in ids.values()}
    nv = {n: [rnd.uniform(-3, 3) for _ in range(DIM)] for n in {n for p in path.values() for n, _ in p}}
    params = spark.createDataFrame([("word", i, v) for i, v in wv.items()] + [("node", i, v) for i, v in nv.items()],
                                   "kind string, id bigint, vec array<double>")
    toks = {r["doc_id"]: [ids[w] for w in r["w"]] for r in docs.select(
        "doc_id", tokenize(F.col("text"), "C").alias("w")).collect()}
    return prep, params, wv, nv, path, toks


def sigma(x):
    return 0.0 if x <= -6 else 1.0 if x >= 6 else 1.0 / (1.0 + math.exp(-x))


def loop_pairs(tokens, half=4):
    for i, w in enumerate(tokens):
        for j in range(max(0, i - half), min(len(tokens) - 1, i + half) + 1):
            if j != i:
                yield w, tokens[j]


def test_prepared_tables(spark, docs, small):
    prep, *_ , toks = small
    words = prep.words.orderBy("id").collect()
    assert [r["id"] for r in words] == list(range(len(words)))
    assert words == sorted(words, key=lambda r: (-r["count"], r["word"]))
    got = {r["doc_id"]: (r["pos"], r["ids"]) for r in prep.docs.collect()}
    assert got == {d: (list(range(len(t))), t) for d, t in toks.items() if t}
    cooc = {(r["id"], r["context"]): r["n"] for r in tr.cooccurrence(prep).collect()}
    want = {}
    for t in toks.values():
        for p in loop_pairs(t):
            want[p] = want.get(p, 0) + 1
    assert cooc == want


@pytest.mark.parametrize("cell_words", [1000, 5, 3])
def test_gradient_matches_loop_at_any_cell_size(spark, small, cell_words):
    prep, params, wv, nv, path, toks = small
    g = tr.hs_gradient(tr.word_targets(tr.cooccurrence(prep), prep.words), params, cell_words).collect()
    want = {("word", i): np.zeros(DIM) for i in wv} | {("node", n): np.zeros(DIM) for n in nv}
    steps = 0
    for t in toks.values():
        for w, c in loop_pairs(t):
            for node, label in path[c]:
                e = label - sigma(float(np.dot(wv[w], nv[node])))
                want["node", node] += e * np.array(wv[w])
                want["word", w] += e * np.array(nv[node])
                steps += 1
    assert sum(r["n"] for r in g if r["kind"] == "word") == sum(r["n"] for r in g if r["kind"] == "node") == steps
    assert {(r["kind"], r["id"]) for r in g} == set(want)
    for r in g:
        assert np.allclose(r["grad"], want[r["kind"], r["id"]], atol=1e-9), r


def changed(found):
    """Changes of shards added up by key; the loss and steps of all."""
    out, loss = {}, np.zeros(2)
    for r in found.collect():
        if r["block"] == tr.LOSS_BLOCK:
            loss += r["change"]
            continue
        flat = np.array(r["change"]).reshape(len(r["keys"]), -1)
        for k, v in zip(r["keys"], flat):
            out[k] = out.get(k, 0) + v
    return {("node", -k) if k < 0 else ("word", k): v for k, v in out.items()}, loss


@pytest.mark.parametrize("replicas, shards, size, unit", [
    (1, 1, 1000, "pair"), (3, 2, 7, "pair"), (3, 3, 1, "pair"), (5, 5, 1000, "pair"),
    (1, 1, 1000, "centre"), (3, 2, 9, "centre"), (3, 3, 1, "centre")])
def test_local_sgd_matches_loop(spark, small, monkeypatch, replicas, shards, size, unit):
    """Pair by pair, or centre by centre, in each replica, from the same vectors, whatever shares a shard."""
    monkeypatch.setattr(tr, "SLICE_PAIRS", size)
    prep, params, wv, nv, path, toks = small
    lr = 0.05
    work = tr.replicas_of(prep.docs, prep.words, replicas, len(wv), shards)
    blocks = tr.packed(params, work.n_blocks)
    got, (got_loss, got_steps) = changed(tr.local_sgd(work, blocks, lr, unit=unit))
    dealt = {}
    for r in work.rows.where("part > 0").orderBy("id").collect():
        dealt.setdefault(r["part"], []).append(r["b"])
    assert sorted(t for texts in dealt.values() for t in texts) == sorted(t for t in toks.values() if t)
    change, steps, loss = {}, 0, 0.0
    for texts in dealt.values():
        W, N = ({k: np.array(v) for k, v in d.items()} for d in (wv, nv))
        for t in texts:
            pairs = [(i, t[i], t[j]) for i in range(len(t)) for j in range(max(0, i - 4), min(len(t) - 1, i + 4) + 1) if j != i]
            assert [p[1:] for p in pairs] == list(loop_pairs(t))
            units = [[p] for p in pairs] if unit == "pair" else [
                [p for p in pairs if p[0] == i] for i in sorted({p[0] for p in pairs})]
            for some in units:
                w, upd, nodes = some[0][1], np.zeros(DIM), {}
                for _, _, c in some:
                    for node, label in path[c]:
                        s = sigma(float(W[w] @ N[node]))
                        g = lr * (label - s)
                        loss -= math.log(max(s if label else 1 - s, tr.LOSS_FLOOR))
                        upd += g * N[node]
                        nodes[node] = nodes.get(node, 0) + g * W[w]
                        steps += 1
                for node, change_of in nodes.items():
                    N[node] = N[node] + change_of
                W[w] = W[w] + upd
        for kind, now, base in (("word", W, wv), ("node", N, nv)):
            for k, v in now.items():
                change[kind, k] = change.get((kind, k), 0) + v - np.array(base[k])
    for key, v in got.items():
        assert np.allclose(v, change[key], atol=1e-9), key
    assert all(k in got for k, v in change.items() if np.abs(v).max() > 0)
    assert got_steps == steps and got_loss == pytest.approx(loss, abs=1e-5)
    # averaging divides by the configured replicas and keeps untouched rows
    new = tr.unpacked(tr.stepped(blocks, tr.local_sgd(work, blocks, lr, unit=unit), tr.averaging(replicas)))
    after = {(r["kind"], r["id"]): r["vec"] for r in new.collect()}
    base = {("word", k): v for k, v in wv.items()} | {("node", k): v for k, v in nv.items()}
    assert after.keys() == base.keys()
    assert all(np.allclose(after[k], np.array(v) + change.get(k, 0) / replicas, atol=1e-9) for k, v in base.items())
    work.drop()


def test_blocks_hold_all_rows(small):
    prep, params, wv, nv, *_ = small
    for n in (1, 4, 100):
        blocks = tr.packed(params, n)
        assert {(r["kind"], r["id"]): r["vec"] for r in tr.unpacked(blocks).collect()} == {
            (r["kind"], r["id"]): r["vec"] for r in params.collect()}
    assert sorted(r["node"] for r in tr.tree_nodes(prep.words).collect()) == sorted(nv)


def test_folding_equals_paths(small):
    prep, *_ = small
    codes = {r["id"]: (r["code"], r["len"]) for r in prep.words.collect()}
    rnd = random.Random(3)
    for _ in range(50):
        some = rnd.sample(sorted(codes), rnd.randrange(0, len(codes)))
        n = {i: rnd.randrange(1, 9) for i in some}
        code, size = (np.array([codes[i][k] for i in some], dtype=np.int64) for k in (0, 1))
        got = tr.fold(code, size, np.array([n[i] for i in some], dtype=np.int64))
        want = {}
        for i in some:
            c, length = codes[i]
            for d in range(length):
                node, bit = (1 << d) + (c >> (length - d)), (c >> (length - d - 1)) & 1
                a, b = want.get(node, (0, 0))
                want[node] = (a + n[i], b + n[i] * (1 - bit))
        assert {int(v): (int(a), int(b)) for v, a, b in zip(*got)} == want


def exchanges_above(plan, table):
    """Exchanges between the root of a plan and the scan of a table."""
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "Scan" in line and table in line)
    depth, out = lines[at].index("Scan"), 0
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if indent < depth:
            depth = indent
            out += "Exchange" in line.split("[")[0].split("(")[0] + line[indent:indent + 20]
    return out


def test_work_stays_where_it_lies(spark, small):
    """In an iteration only vectors move: no exchange above the scan of the work."""
    prep, params, wv, *_ = small
    for work, job in ((tr.replicas_of(prep.docs, prep.words, 3, len(wv), 3), tr.local_sgd),
                      (tr.cells(tr.word_targets(tr.cooccurrence(prep), prep.words), len(wv)), tr.gradient)):
        blocks = tr.written(tr.packed(params, work.n_blocks), "params")
        plan = tr.stepped(blocks, job(work, blocks), tr.averaging(3))._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan
        # the only exchange above the work is that of the changes it makes
        assert exchanges_above(plan, work.rows._wordloom_table) == 1
        found = job(work, blocks)._jdf.queryExecution().executedPlan().toString()
        assert exchanges_above(found, work.rows._wordloom_table) == 0
        assert exchanges_above(found, "params") >= 1
        work.drop()


def test_local_fits_are_equal_bit_for_bit(spark, real):
    """The shards, like any other partitioning, change nothing."""
    docs, prep = real
    fits = [{(r["kind"], r["id"]): r["vec"] for r in tr.fit_local(docs, iters=1, replicas=16, dim=8, prep=prep, shards=n).rows().collect()}
            for n in (1, 5, 16)]
    assert fits[0] == fits[1] == fits[2]


def test_twice_the_corpus_moves_a_word_as_far(spark, real):
    """Replicas are a setting: the same documents again do not halve a step."""
    docs, prep = real
    twice = tr.written(prep.docs.unionByName(prep.docs.withColumn("doc_id", F.col("doc_id") + 1_000_000)), "twice")

    def moved(d):
        fit = tr.fit_local(None, iters=1, dim=8, prep=tr.Prepared(prep.words, d))
        start = {r["id"]: np.array(r["vec"]) for r in tr.unpacked(tr.packed(tr.init_params(prep, 8), 4)).where("kind = 'node'").collect()}
        return sum(float(np.abs(np.array(r["vec"]) - start[r["id"]]).sum()) for r in fit.rows().where("kind = 'node'").collect())
    assert moved(twice) > 1.5 * moved(prep.docs)


@pytest.mark.parametrize("size", [1, 5, 8, 1000])
def test_pairs_come_in_slices(small, size):
    *_, toks = small
    docs = [(np.arange(len(t)), np.array(t, dtype=np.int64)) for t in toks.values()]
    got = list(tr.pair_slices(docs, 4, size))
    assert all(len(c) == len(x) <= size + 8 * max(1, size // 8) for c, x in got)
    assert [p for c, x in got for p in zip(c[:, 1].tolist(), x.tolist())] == [p for t in toks.values() for p in loop_pairs(t)]
    places = [set(c[:, 0].tolist()) for c, _ in got]
    assert sum(map(len, places)) == len(set().union(*places))       # no centre is in two slices


def test_steps_of_a_centre_and_of_a_pair_differ_little(spark, real):
    """Both take the same gradients: with a small rate the same fit."""
    docs, prep = real
    a, b = ({(r["kind"], r["id"]): np.array(r["vec"]) for r in tr.fit_local(
        docs, iters=1, replicas=8, dim=8, lr=0.001, prep=prep, unit=u).rows().collect()} for u in ("centre", "pair"))
    start = {(r["kind"], r["id"]): np.array(r["vec"]) for r in tr.init_params(prep, 8).collect()}
    apart = sum(np.abs(a[k] - b[k]).sum() for k in a)
    moved = sum(np.abs(a[k] - start[k]).sum() for k in a)
    assert apart < 0.02 * moved


def test_repeated_ids_raise(spark):
    twice = spark.createDataFrame([(1, "a b c"), (1, "d e f")], "doc_id int, text string")
    for job in (lambda: tr.prepare(twice), lambda: tr.fit_sync(twice), lambda: tr.fit_local(twice),
                lambda: sg.skipgram_pairs(twice, vo.word_counts(twice))):
        with pytest.raises(ValueError, match="unique"):
            job()


@pytest.fixture(scope="module")
def real(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    return docs, tr.prepare(docs)


def test_root_targets_equal_pairs(spark, real):
    docs, prep = real
    t = tr.node_targets(tr.word_targets(tr.cooccurrence(prep), prep.words)).where("node = 1").join(prep.words, "id")
    counts = vo.word_counts(docs)
    pairs = sg.skipgram_pairs(docs, vo.tree_words(counts), frequent=vo.frequent_words(counts))
    assert {r["word"]: r["n"] for r in t.collect()} == {r["word"]: r["count"] for r in pairs.groupBy("word").count().collect()}


def test_synchronous_training_learns_with_its_defaults(spark, real):
    """The loss never rises and falls well below ln 2; no component can leave
    the start by more than rate x iterations."""
    docs, prep = real
    iters = 8
    fit = tr.fit_sync(docs, iters=iters, prep=prep)
    assert fit.losses[0] == pytest.approx(math.log(2), abs=1e-9)      # zero nodes: sigma = 1/2
    assert all(b <= a for a, b in zip(fit.losses, fit.losses[1:]))
    assert fit.losses[-1] < 0.61
    top = max(abs(x) for r in fit.rows().collect() for x in r["vec"])
    assert top <= 0.005 + iters * tr.LEARNING_RATE
    vecs = tr.vectors_of(fit).collect()
    assert len(vecs) == 916
    start = {r["word"]: r["vec"] for r in tr.init_word_vectors(prep.words).collect()}
    assert all(r["vec"] != start[r["word"]] for r in vecs)


def test_local_training_learns_and_reports_every_iteration(spark, real):
    docs, prep = real
    top = [r["word"] for r in prep.words.orderBy("id").limit(3).collect()]
    fit = tr.fit_local(docs, iters=3, replicas=8, prep=prep, probes=tr.Probes(top, [tuple(top), ("no", "such", "words")], k=4))
    assert math.log(2) > fit.losses[0] > fit.losses[1] > fit.losses[2]
    rows = tr.training_report(fit).collect()
    for it in (1, 2, 3):
        now = [r for r in rows if r["iteration"] == it]
        assert [r["value"] for r in now if r["kind"] == "loss"] == [fit.losses[it - 1]]
        near = [r for r in now if r["kind"] == "nearest"]
        assert len(near) == 12 and {r["word"] for r in near if r["rank"] == 1} == set(top)
        answer = [r for r in now if r["kind"] == "analogy"]
        assert len(answer) == 1 and answer[0]["word"] not in top


def test_mini_batches_take_turns(spark, real):
    docs, prep = real
    fit = tr.fit_local(docs, iters=2, replicas=16, batches=2, schedule="linear", prep=prep)
    assert len(fit.losses) == 2 and all(0 < x < math.log(2) for x in fit.losses)
    start = {r["word"]: r["vec"] for r in tr.init_word_vectors(prep.words).collect()}
    assert all(r["vec"] != start[r["word"]] for r in tr.vectors_of(fit).collect())


@pytest.mark.parametrize("query", ["word_vectors", "fit_local"])
def test_registered_local_training_runs_every_iteration(spark, monkeypatch, query):
    """The queries run the reference's 30 iterations."""
    asked = {}

    def stop(corpus, **settings):
        asked.update(settings)
        raise InterruptedError

    monkeypatch.setattr(tr, "fit_local", stop)
    with pytest.raises(InterruptedError):
        catalog.queries()[query](spark, SF001)
    assert tr.ITERATIONS == 30 and asked.get("iters", tr.ITERATIONS) == 30


def test_init_ranges_batches_and_schedule(spark, docs):
    w = tr.init_word_vectors(vo.word_counts(docs), dim=100, seed=3).collect()
    assert all(-0.005 <= x < 0.005 for r in w for x in r["vec"])
    b = tr.assign_batches(docs, 2, seed=1)
    assert {r["batch"] for r in b.collect()} <= {0, 1}
    assert tr.select_batch(b, 0).count() + tr.select_batch(b, 1).count() == docs.count()
    assert tr.learning_rate(29, 30, schedule="constant") == 0.025
    assert tr.learning_rate(29, 30, schedule="linear") == pytest.approx(0.025 / 30)
    assert tr.learning_rate(30, 30, schedule="linear") == pytest.approx(0.025e-4)


@pytest.mark.parametrize("most, scale", [(1, 1.0), (4, 1.0), (16, 1.0), (16, 0.01)])
def test_runs_of_steps_equal_steps_one_by_one(monkeypatch, most, scale):
    """steps taken together, a run with no word twice, move vectors as
    steps taken in turn, also where scores reach the clip; a run reads a node's
    vector once."""
    monkeypatch.setattr(tr, "RUN_STEPS", most)
    rnd = np.random.default_rng(5)
    length = rnd.integers(2, 7, 40)
    nodes = np.concatenate([40 + rnd.permutation(30)[:k] for k in length])
    paths = tr.Paths(nodes, rnd.integers(0, 2, len(nodes)), np.cumsum(length) - length, length)
    row, vecs = rnd.permutation(40), rnd.normal(0, scale, (70, 8))
    docs = [(np.sort(rnd.permutation(90)[:60]), rnd.integers(0, 40, 60)), (np.arange(9), np.full(9, 3)), (np.arange(1), np.array([7]))]
    [(place, context)] = list(tr.pair_slices(docs, 4, 10_000))
    runs = tr.by_centre(place[:, 0], place[:, 1], context, paths, row)
    assert np.diff(runs.begin).max() <= most
    assert all(len(set(runs.centres[x:y])) == y - x for x, y in zip(runs.begin, runs.begin[1:]))
    assert all(len(set(runs.nodes[x:y])) == y - x for x, y in zip(runs.cut, runs.cut[1:]))
    assert runs.n.sum() == length[context].sum() and runs.n1.sum() == sum(paths.labels[o:o + k].sum() for o, k in zip(paths.off[context], length[context]))
    want, scores, steps = vecs.copy(), [], 0
    for i in range(len(runs.begin) - 1):
        here = runs.nodes[runs.cut[i]:runs.cut[i + 1]]
        n, n1 = (x[runs.off[i]:runs.off[i + 1]].reshape(-1, len(here)) for x in (runs.n, runs.n1))
        for c, a, b in zip(runs.centres[runs.begin[i]:runs.begin[i + 1]], n, n1):
            on = np.flatnonzero(a)
            scores.append(tr.sgd(want, np.array([c]), np.array([0, len(on)]), here[on], a[on], b[on], 0.3))
            steps += 1
    got = vecs.copy()
    found = -tr.sgd_runs(got, runs, 0.3)
    assert steps == len(set(place[:, 0]))
    assert np.allclose(found[runs.n > 0], np.concatenate(scores), atol=1e-9)
    assert np.allclose(got, want, atol=1e-9) and not np.allclose(got, vecs, atol=1e-3)
    if scale == 1.0:
        assert np.abs(found[runs.n > 0]).max() > 6 > np.abs(found[runs.n > 0]).min()


@pytest.mark.parametrize("words, density", [(1, 0.03), (3, 0.5), (7, 2.0), (64, 0.0), (64, 0.03)])
def test_gradient_of_tiles_equals_rows(monkeypatch, words, density):
    """nodes met by many words as dense columns, the others one by one."""
    monkeypatch.setattr(tr, "TILE_WORDS", words)
    monkeypatch.setattr(tr, "TILE_DENSITY", density)
    rnd = np.random.default_rng(2)
    met = [np.sort(rnd.permutation(50)[:rnd.integers(0, 30)]) + 1 for _ in range(23)]
    n = [rnd.integers(1, 9, len(m)) for m in met]
    n1 = [rnd.integers(0, k + 1) for k in n]
    ids = rnd.permutation(23)
    keys = np.concatenate([np.arange(-50, 0), np.arange(23)])
    shard = tr.Shard(keys, rnd.normal(0, 1.5, (len(keys), 6)))
    lists = [pa.array([x[i].tolist() for i in ids], pa.list_(pa.int64())) for x in (met, n, n1)]
    tr.gradient_kernel(shard, pa.table([pa.array(ids), *lists], names=["id", "a", "b", "c"]))
    change, steps, loss = np.zeros_like(shard.base), np.zeros(len(keys), int), 0.0
    for w in range(23):
        for m, a, b in zip(met[w], n[w], n1[w]):
            s = sigma(float(shard.base[50 + w] @ shard.base[50 - m]))
            change[50 + w] += (b - a * s) * shard.base[50 - m]
            change[50 - m] += (b - a * s) * shard.base[50 + w]
            loss += tr.loss_of(np.array([s]), np.array([a]), np.array([b]))
            steps[[50 + w, 50 - m]] += a
    assert np.allclose(shard.change, change, atol=1e-9) and (shard.n == steps).all()
    assert shard.loss == pytest.approx(loss) and shard.steps == sum(k.sum() for k in n)


def test_cells_are_even_rounds_of_the_cores(spark, small):
    """nine cells on eight cores took two rounds, the second of one cell."""
    for cores in range(1, 200):
        across, down = tr.grid_for(cores, 1)
        assert cores <= across * down <= cores + across and down <= 4 * across
        assert min(tr.grid_for(cores, 5)) >= 5
    assert [tr.grid_for(k, 1) for k in (4, 8, 12, 16, 24)] == [(2, 2), (2, 4), (3, 4), (4, 4), (4, 6)]
    prep, params, wv, *_ = small
    targets = tr.word_targets(tr.cooccurrence(prep), prep.words)
    work = tr.cells(targets, len(wv))
    assert work.rows.select("shard").distinct().count() <= tr.shards_for(spark)
    got = sorted((r["id"], v, a, b) for r in work.rows.collect() for v, a, b in zip(r["a"], r["b"], r["c"]))
    assert got == sorted(map(tuple, tr.node_targets(targets).collect()))
    parts = tr.part_of(np.arange(1, 4097), 4)
    assert all(0.2 < (parts[b::2] == p).mean() < 0.3 for b in (0, 1) for p in range(4))
    work.drop()
