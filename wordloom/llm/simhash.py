"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: bit b is set if more than half of the shingles' 64-bit hashes
have it. Two fingerprints link when they differ in at most ``max_bits`` bits;
a document's component is the smallest id reachable over links.

Work is done on distinct fingerprints, so copies cost one row each. Their 64
bits are grouped into m parts, correlated bits together (bits that vary
together then waste one part, not several). By the generalised pigeonhole
principle, thresholds t_i of at least -1 with sum max_bits - m + 1 lose
nothing: any linked pair differs by at most t_i bits in some part i (a part at
-1 is not looked at). A dynamic program picks the thresholds with the least
estimated work, from the exact number of pairs that agree on a part and the
bits' frequencies; m is the cheapest of :data:`PARTS`. A part at threshold t
is probed with every value within t bits of the fingerprint's own, candidates
are verified on all 64 bits.

A part value shared by more than :data:`HOT_VALUE` fingerprints is not paired.
Its fingerprints are linked through every 64-bit value within half the
distance: two fingerprints link exactly if they share such a centre (for an
odd distance one of them one step closer), and all that share one belong
together, so a star per centre replaces all pairs of the group. The rows are
linear in the fingerprints and the links found are complete.

Components come from alternating large-star and small-star rounds over the
links, each round written to the shared folder.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import map_batches, remove, written
from wordloom.llm.words import texts_of

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
PARTS = (1, 2, 3, 4)
HOT_VALUE = 64
ROW_COST = 2.0   # a probe row (shuffled) against one verified candidate


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The SimHash of one whole text; zero if it has no word."""
    import xxhash
    parts = text.encode("utf-8", "surrogatepass").lower().split()   # ASCII only, on bytes
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(parts) - words + 1)
    last = ends[-k:]
    h = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, dtype=np.int64)
    for i in range(0, k, 1 << 16):      # bounded memory for long texts
        j = min(k, i + (1 << 16))
        values = np.array([h(line[a:b], seed) for a, b in zip(starts[i:j].tolist(), last[i:j].tolist())],
                          dtype="<u8")
        set_bits += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > k).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``(id, fp)``, the fingerprint as a signed 64-bit integer. Words are
    ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; null texts have none."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words, seed) for t in texts_of(b.column(1)).to_pylist()], dtype="<u8")
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view("<i8"))], ["id", "fp"])
    return map_batches(docs.select(F.col(id_col).cast("bigint"), text_col), run, "id bigint, fp bigint")


# ------------------------------------------------------------- parts and plan

def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both
    set: 64 x 64 sums, one row per batch before Spark adds them up."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.unpackbits(b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little").astype(np.float32)
        both = (bits.T @ bits).astype(np.int64).ravel()
        return pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([both.tolist()])], ["n", "both"])
    sums = map_batches(prints.select("fp"), run, "n bigint, both array<bigint>")
    rows = sums.select("n", F.posexplode("both")).groupBy("pos").agg(
        F.sum("col").alias("s"), F.sum("n").alias("n")).collect()      # 4096 rows
    both = np.zeros(64 * 64)
    for r in rows:
        both[r["pos"]] = r["s"]
    return (int(rows[0]["n"]) if rows else 0), both.reshape(64, 64)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits dealt into m parts of near equal size, each grown from the free bit
    most correlated with the other free bits, by those most correlated with it."""
    p = np.diag(both) / max(n, 1)
    var = p * (1 - p)
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.sqrt(np.maximum(np.outer(var, var), 1e-12))
    free, parts = set(range(64)), []
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        part = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum() - corr[b, b])]
        free.discard(part[0])
        while len(part) < size:
            nxt = max(sorted(free), key=lambda b: corr[b, part].sum())
            part.append(nxt)
            free.discard(nxt)
        parts.append(sorted(part))
    return parts


def distance_law(p: np.ndarray, most: int) -> np.ndarray:
    """Probability that two values differ in 0, 1, .. ``most`` of bits that
    are set with frequencies ``p`` independently."""
    law = np.zeros(most + 1)
    law[0] = 1.0
    for q in 2 * p * (1 - p):
        law[1:] = law[1:] * (1 - q) + law[:-1] * q
        law[0] *= 1 - q
    return law


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 of sum ``total`` with the least sum of costs;
    ``costs[i][t + 1]`` is the cost of part i at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for spent, (value, chosen) in best.items():
            for t in range(-1, len(cost) - 1):
                entry = (value + cost[t + 1], [*chosen, t])
                if spent + t not in nxt or entry < nxt[spent + t]:
                    nxt[spent + t] = entry
        best = nxt
    return best[total]


def part_value(fp: Column, part: list[int]) -> Column:
    mask = sum(1 << b for b in part)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def plan(spark: SparkSession, prints: DataFrame, max_bits: int) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of each part worth probing."""
    n, both = bit_statistics(prints)
    p = np.diag(both) / max(n, 1)
    options = {m: correlated_parts(n, both, m) for m in PARTS if m <= max_bits + 2}
    agree = {}
    keyed = prints.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), part_value(F.col("fp"), part).alias("v"))
        for m, parts in options.items() for i, part in enumerate(parts)])).alias("k")).select("k.*")
    for r in keyed.groupBy("m", "i", "v").count().groupBy("m", "i").agg(
            F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect():   # a row per part
        agree[r["m"], r["i"]] = float(r["pairs"])
    choices = []
    for m, parts in options.items():
        costs = []
        for i, part in enumerate(parts):
            law = distance_law(p[part], max_bits)
            scale = max(agree.get((m, i), 0.0) / max(law[0], 1e-300), 0.0) if agree.get((m, i)) else n * (n - 1) / 2
            scale = min(scale, n * (n - 1) / 2)
            costs.append([0.0] + [n * ROW_COST * (1 + sum(comb(len(part), d) for d in range(t + 1)) * (t > 0))
                                  + scale * float(law[:t + 1].sum()) for t in range(max_bits + 1)])
        cost, thresholds = allocate(costs, max_bits - m + 1)
        choices.append((cost, m, [(part, t) for part, t in zip(parts, thresholds) if t >= 0]))
    return min(choices, key=lambda c: (c[0], c[1]))[2]


# ---------------------------------------------------------------------- links

def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def flips(bits: list[int], most: int) -> list[int]:
    """Signed masks with up to ``most`` of ``bits`` set."""
    masks = [sum(1 << b for b in c) for d in range(most + 1) for c in combinations(bits, d)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def long_array(values: list[int]) -> Column:
    """An array constant (folded from text, so that long lists stay one literal)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def part_links(prints: DataFrame, part: list[int], threshold: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Verified links between fingerprints that differ by up to ``threshold``
    bits in ``part``, and the fingerprints left to :func:`centre_links`."""
    keyed = prints.select("fp", part_value(F.col("fp"), part).alias("v"))
    probes = keyed if threshold == 0 else keyed.select("fp", F.explode(F.transform(
        long_array(flips(part, threshold)), lambda x: F.col("v").bitwiseXOR(x))).alias("v"))
    # fingerprints that would meet at one value
    crowd = probes.groupBy("v").count().filter(F.col("count") > HOT_VALUE).select("v")
    hot = probes.join(crowd, "v", "left_semi").select("fp").distinct()
    calm = probes.join(crowd, "v", "left_anti")
    index = (keyed if threshold else calm).withColumnRenamed("fp", "other")
    links = calm.join(index, "v").filter(
        (F.col("fp") < F.col("other")) & (distance(F.col("fp"), F.col("other")) <= max_bits))
    return links.select(F.col("fp").alias("a"), F.col("other").alias("b")), hot


def centre_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Stars that connect all linked pairs of ``prints`` and no others.

    Every fingerprint is sent to the values within ``max_bits // 2`` bits
    (near) and, for an odd distance, to those one bit further (far). Near
    ones of a centre are linked to each other; far ones to a near one."""
    near = max_bits // 2
    masks = flips(list(range(64)), near + max_bits % 2)
    rows = prints.select("fp", F.explode(F.transform(long_array(masks), lambda x: F.struct(
        F.col("fp").bitwiseXOR(x).alias("c"), (F.bit_count(x) <= near).alias("near")))).alias("x")) \
        .select("fp", "x.c", "x.near")
    least = rows.filter("near").groupBy("c").agg(F.min("fp").alias("a"), F.count("*").alias("n"))
    if max_bits % 2 == 0:
        least = least.filter("n > 1")
    return rows.join(least, "c").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints whose connected components
    are those of all pairs within ``max_bits`` bits."""
    out = None
    hot = None
    for part, threshold in plan(prints.sparkSession, prints, max_bits):
        found, crowd = part_links(prints, part, threshold, max_bits)
        out = found if out is None else out.unionByName(found)
        hot = crowd if hot is None else hot.unionByName(crowd)
    return out.unionByName(centre_links(hot.distinct(), max_bits)).distinct()


# ----------------------------------------------------------------- components

def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``(node, root)``: the least node of each connected component, for the
    nodes of ``edges (a, b)``. Large-star and small-star rounds until no edge
    changes; a node's star goes through one partial aggregate, never a list."""
    now = written(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                              F.col("m").alias("b")).filter("a <> b").distinct()
        nxt = written(spark, small, "edges")
        after = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        remove(spark, now)
        now = nxt
        if after == before:
            break
        before = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select("b", F.col("b").alias("root")).distinct().withColumnRenamed("b", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row: 16 lower-case hex
    digits, and the least id reachable over links, its own included.

    Null and wordless texts have fingerprint zero and link like any other.
    Rows with a repeated id come out as often as they came in; a null id is
    no candidate for the least id (a component of null ids only has null).
    """
    spark = docs.sparkSession
    by_doc = written(spark, fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    prints = written(spark, by_doc.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    comp = components(spark, links(prints.select("fp"), max_bits))
    label = prints.join(comp, prints["fp"] == comp["node"], "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    label = written(spark, label, "labels")
    least = label.groupBy("root").agg(F.min("first").alias("component_id"))
    out = by_doc.join(label.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")
