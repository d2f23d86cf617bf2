import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from edge import empty_documents, hard_documents

from wordloom.llm import simhash
from wordloom.llm.queries import op2_simhash

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    """Least index reachable for each of a list of fingerprints."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check(rows, docs):
    ids = sorted((i for i, _ in docs))
    text = dict(docs)
    prints = [brute_fingerprint(text[i]) for i in ids]
    comp = brute_components(prints, 2)
    want = {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, comp)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want


@pytest.mark.parametrize("hot", [simhash.HOT_VALUE, 1])
def test_table_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_VALUE", hot)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(op2_simhash(spark, SF).collect(), docs)


def test_hard_rows(spark):
    docs = hard_documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    check([r for r in rows if r.doc_id is not None], [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {0}
    assert simhash.near_duplicates(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, bits):
    rnd = random.Random(bits)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for c in centres for _ in range(25)}
    prints = sorted(map(signed, prints))
    frame = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    want = brute_components([p & (1 << 64) - 1 for p in prints], bits)
    for hot in (64, 2):
        monkeypatch.setattr(simhash, "HOT_VALUE", hot)
        comp = {r.node: r.root for r in simhash.components(spark, simhash.links(frame, bits)).collect()}
        assert [comp.get(p, p) for p in prints] == [prints[c] for c in want]


def test_allocation_is_the_cheapest():
    rnd = random.Random(1)
    for m, bits in ((2, 2), (3, 2), (3, 4), (4, 2)):
        costs = [[0.0, *sorted(rnd.random() * 9 for _ in range(bits + 1))] for _ in range(m)]
        total = bits - m + 1
        want = min(sum(c[t + 1] for c, t in zip(costs, ts)) for ts in itertools.product(range(-1, bits + 1), repeat=m)
                   if sum(ts) == total)
        cost, ts = simhash.allocate(costs, total)
        assert sum(ts) == total and cost == pytest.approx(want)


def test_parts_hold_every_bit_once_and_group_correlated_bits():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (4000, 64))
    bits[:, 32:48] = bits[:, [32]]            # sixteen equal bits
    parts = simhash.correlated_parts(4000, (bits.T @ bits).astype(float), 4)
    assert sorted(sum(parts, [])) == list(range(64))
    assert any(set(range(32, 48)) <= set(p) for p in parts)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    comp = {r.node: r.root for r in simhash.components(spark, edges).collect()}
    assert comp == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
