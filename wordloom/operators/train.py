"""Skip-gram word vectors with hierarchical softmax, trained as Spark jobs.

Parameters are rows ``(block, keys, vecs, acc)``: the vectors of a block of
keys, one after the other. A word's key is its place by descending count, the
key of an internal node its heap number (see ``huffman``) with a minus sign.
Block -1 holds the loss and the number of steps of every round so far.

Both trainers repeat one kind of job, :func:`changes`. Work is dealt to shards
and written once, bucketed by shard, with a list of the keys each shard needs,
bucketed by block. An iteration hands every shard the vectors it needs and
runs a numpy kernel on the shard's work, which is read where it lies
(co-grouped with the vectors, no exchange of work); what changed is added up
by block and the next parameters are written. Only vectors move. Nothing is
broadcast or collected, and the same plan runs at every model size: a task
holds one shard's work and vectors.

- **Synchronous** (:func:`fit_sync`): the full-batch gradient at fixed
  parameters depends on a pair only through (word, node, label), so
  co-occurrences are folded up the code tree once, before training. A shard is
  a cell of a grid, some of the words by some of the nodes; its work is one
  row a word with arrays of nodes and counts. The kernel takes some words at a
  time: the nodes that enough of them meet as a dense tile, three matrix
  products, the others word by word and node by node. The step is per coordinate: ``lr * g / sqrt(sum of g^2 so far)``
  (AdaGrad), so no coordinate moves more than ``lr`` an iteration whatever the
  corpus size.
- **Local SGD with parameter averaging** (:func:`fit_local`), the reference's
  scheme: documents are dealt to a fixed number of replicas; each takes SGD
  steps in order of documents and positions, from the same parameters, and the
  new parameters are ``base + sum(changes) / replicas``. A step takes the up to
  8 pairs of a centre together, each node on their paths once; steps of
  neighbouring centres are worked out as one small dense problem
  (:func:`sgd_runs`). ``unit="pair"`` takes the pairs one by one as the
  reference does, much slower. Both move by
  the same gradients, a centre's pairs only do not see one another's change. A shard holds some replicas and works them off one after the
  other on one copy of its vectors, put back in between. A replica's changes
  are rounded to multiples of 2^-40, whose sums are exact: a fit is the same
  bit for bit under any number of shards and any order.

Tables of an iteration are removed when the next one is written, work when the
fit is done.

The logistic is clipped at +-6 (exactly 0 or 1), and the update is still
applied there, as in the reference. The reference's learning-rate decay used
an integer division and so never decayed: ``constant`` is what it does and the
default, ``linear`` what it intends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import vector as V
from wordloom.functions.hashing import TWO_32, hash32, keyed
from wordloom.operators import huffman as hf
from wordloom.operators import located
from wordloom.operators import skipgram as sg
from wordloom.operators import vocab as vo
from wordloom.session import bucketed, drop_bucketed, release, remove_written, scratch_path, ship_package, written
from wordloom.sources.corpus import check_unique_ids

# Training settings of the reference program.
DIM = 100
LEARNING_RATE = 0.025
ITERATIONS = 30
MIN_LR_FRACTION = 1e-4
REPLICAS = 320

BLOCK_KEYS = 512         # keys in a block of parameters
CELL_WORDS = 16_384      # words, and nodes, in a cell of the gradient's grid, at most
SHARD_TOKENS = 4_000_000  # known tokens in a shard of replicas, at most as expected
SHARDS_PER_CORE = 1
CELL_ENTRIES = 2_000_000  # (word, node) targets in a cell, as expected
SLICE_ENTRIES = 1 << 18  # of them that are dealt, or added up node by node, at once
TILE_WORDS = 256         # words of a cell that are taken at once
TILE_DENSITY = 0.03      # share of them that must meet a node for a dense column
SLICE_CONTEXTS = 65_536  # contexts folded at once
RUN_STEPS = 16           # steps of local SGD that are taken as one dense problem, at most
SLICE_PAIRS = 32_768     # pairs of a replica that are laid out at once
LOSS_FLOOR = 1e-7        # sigma is kept this far from 0 and 1 in the reported loss
QUANTUM = 2.0 ** -40     # a replica's changes are multiples of it
LOSS_QUANTUM = 2.0 ** -20
LOSS_BLOCK = -1


def learning_rate(it: int, iters: int, start: float = LEARNING_RATE, schedule: str = "constant") -> float:
    if schedule == "constant":
        return start
    if schedule == "linear":
        return max(start * (1.0 - it / iters), start * MIN_LR_FRACTION)
    raise ValueError(f"unknown schedule {schedule!r}")


# ----------------------------------------------------------------- preparation

@dataclass
class Prepared:
    """What training reads: ``words (word, count, id, len, code)`` and ``docs
    (doc_id, pos array<bigint>, ids array<bigint>)``, the known tokens of a
    document in order of position, each written once; ``paths (id, depth,
    node, label)`` follows from the codes."""
    words: DataFrame
    docs: DataFrame

    @property
    def paths(self) -> DataFrame:
        return hf.huffman_paths(self.words, "id")


def prepare(corpus: DataFrame, preset: str = "C", min_count: int = vo.MIN_COUNT,
            max_freq: float = vo.MAX_FREQ) -> Prepared:
    """Vocabulary, codes and encoded documents. Null or repeated document ids
    raise (D5)."""
    check_unique_ids(corpus)
    counts = written(vo.word_counts(corpus, preset), "counts")
    codes = hf.huffman_codes(vo.tree_words(counts, min_count, max_freq))
    words = written(codes.withColumnRenamed("place", "id"), "words")
    docs = located.known(corpus, words.select("word", F.col("id").alias("ids")), preset, "ids")
    return Prepared(words, written(docs, "docs"))


def uniform_vector(key: Column, dim: int, seed: int) -> Column:
    """Components ``u(key:i:seed) - 0.5``, u uniform in [0, 1) from md5."""
    idx = F.sequence(F.lit(0), F.lit(dim - 1))
    return F.transform(idx, lambda i: hash32(keyed(key, i, seed)) / F.lit(TWO_32) - F.lit(0.5))


def _initial(word: Column, dim: int, seed: int) -> Column:
    return F.transform(uniform_vector(word, dim, seed), lambda x: x / F.lit(float(dim)))


def init_word_vectors(vocab: DataFrame, dim: int = DIM, seed: int = 0) -> DataFrame:
    """``(word, vec)`` with components ``(u(word:i:seed) - 0.5) / dim``."""
    return vocab.select("word", _initial(F.col("word"), dim, seed).alias("vec"))


def tree_nodes(words: DataFrame) -> DataFrame:
    """``(node)``, the internal nodes. A code other than all ones has a last
    zero; the bits before it name the node whose left subtree ends with the
    word, and every internal node is named so once."""
    ones = F.bit_count(F.col("code").bitwiseXOR(F.col("code") + 1)) - 1
    node = F.expr("shiftleft(CAST(1 AS BIGINT), len - ones - 1) + shiftright(code, ones + 1)")
    return words.select("len", "code", ones.alias("ones")).where("ones < len").select(node.alias("node"))


def _spread(words: DataFrame) -> DataFrame:
    """The words dealt to all cores: random vectors take long, and words lie in few files."""
    return words.repartition(words.sparkSession.sparkContext.defaultParallelism, "id")


def init_params(prep: Prepared, dim: int = DIM, seed: int = 0) -> DataFrame:
    """``(kind, id, vec)``: leaves random in (-0.5, 0.5) / dim, internal nodes zero."""
    return _spread(prep.words).select(F.lit("word").alias("kind"), "id", _initial(F.col("word"), dim, seed).alias("vec")).unionByName(
        tree_nodes(prep.words).select(F.lit("node").alias("kind"), F.col("node").alias("id"), V.zeros(dim).alias("vec")))


def random_params(prep: Prepared, dim: int = DIM, seed: int = 0) -> DataFrame:
    """Leaves and nodes random in (-0.5, 0.5): a point at which no gradient
    vanishes. A node's key is ``node <id>``."""
    return _spread(prep.words).select(F.lit("word").alias("kind"), "id", uniform_vector(F.col("word"), dim, seed).alias("vec")) \
        .unionByName(tree_nodes(_spread(prep.words)).select(
            F.lit("node").alias("kind"), F.col("node").alias("id"),
            uniform_vector(F.concat(F.lit("node "), F.col("node")), dim, seed).alias("vec")))


# --------------------------------------------------------- blocks of parameters

PARAMS = "block bigint, keys array<bigint>, vecs array<double>, acc array<double>"


def blocks_for(n_words: int, spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-2 * n_words // BLOCK_KEYS))


def packed(params: DataFrame, n_blocks: int) -> DataFrame:
    """Rows ``(kind, id, vec)`` as blocks, with no history (``acc``) and no loss."""
    key = F.when(F.col("kind") == "node", -F.col("id")).otherwise(F.col("id"))
    rows = params.select(F.pmod(key, F.lit(n_blocks)).cast("bigint").alias("block"), F.struct(key.alias("key"), "vec").alias("r"))
    none = F.array().cast("array<double>")
    blocks = rows.groupBy("block").agg(F.sort_array(F.collect_list("r")).alias("r")).select(
        "block", F.col("r.key").alias("keys"), F.flatten("r.vec").alias("vecs"), none.alias("acc"))
    loss = params.sparkSession.createDataFrame([(LOSS_BLOCK, [], [], [])], PARAMS)
    return blocks.unionByName(loss)


def unpacked(params: DataFrame) -> DataFrame:
    """``(kind, id, vec)`` of blocks ``(block, keys, vecs)``."""
    n = F.size("keys")
    dim = (F.size("vecs") / n).cast("int")
    cut = F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.slice("vecs", i * dim + 1, dim).alias("vec")))
    rows = params.where(n > 0).select(F.explode(cut).alias("r")).select("r.key", "r.vec")
    return rows.select(F.when(F.col("key") < 0, "node").otherwise("word").alias("kind"), F.abs("key").alias("id"), "vec")


# ------------------------------------------------------------ targets and work

def cooccurrence(prep: Prepared, half: int = sg.HALF_WINDOW) -> DataFrame:
    """``(id, context, n)`` from the encoded documents: pairs within ``half``
    positions, both ways, counted inside tasks before the shuffle."""
    return sg.cooccurrence_of_ids(prep.docs, half)


def fold(code: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(nodes, n, n1)`` of one word's contexts with the given codes, code
    lengths and counts: at each level the counts of the codes under a node, and
    of those that go left there. Contexts are put in order of their codes, in
    which a node's leaves are neighbours, so a level is a difference of prefix
    sums at the places where the code's first bits change."""
    return fold_rows(np.zeros(len(code), np.int64), code, size, n)[1:]


def fold_rows(row: np.ndarray, code: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(row, nodes, n, n1)``: :func:`fold` of the contexts of many rows at
    once, a level of all of them at a time, by row. From the deepest level up,
    what lies at a level, contexts that end there and nodes, each known by its
    first context, is put together two by two: neighbours in order of their codes."""
    deepest = int(size.max()) if len(size) else 0
    aligned = code << (deepest - size)
    if not ((row[1:] > row[:-1]) | ((row[1:] == row[:-1]) & (aligned[1:] >= aligned[:-1]))).all():
        order = np.lexsort([aligned, row])
        row, aligned, size, n = row[order], aligned[order], size[order], n[order]
    cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (aligned[1:] != aligned[:-1])][:len(row)])
    if len(cut) < len(row):     # a context that comes twice
        row, aligned, size, n = row[cut], aligned[cut], size[cut], np.add.reduceat(n, cut)
    few, total, out = len(row) and int(row[-1]) < 1 << 16, n.copy(), []
    leaves = np.argsort(size.astype(np.uint8), kind="stable")
    ends = np.searchsorted(size[leaves], np.arange(deepest + 2))
    at = leaves[:0]
    for depth in range(deepest, 0, -1):
        here = leaves[ends[depth]:ends[depth + 1]]
        if len(here):
            at = np.sort(np.concatenate([at, here])) if len(at) else here
        bits, rows, count = aligned[at] >> (deepest - depth), row[at], total[at]
        node, right = bits >> 1, bits & 1
        new = np.empty(len(at) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(node[1:], node[:-1], out=new[1:-1])
        new[1:-1] |= rows[1:] != rows[:-1]
        cut = np.flatnonzero(new[:-1])
        left = np.where(right[cut] == 0, count[cut], 0)
        both = count[cut]
        pair = np.flatnonzero(~new[cut + 1])
        both[pair] += count[cut[pair] + 1]
        at = at[cut]
        total[at] = both
        out.append((rows[cut], (np.int64(1) << (depth - 1)) + node[cut], both, left))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    found = [np.concatenate(x) for x in zip(*reversed(out))]
    order = np.argsort(found[0].astype(np.uint16) if few else found[0], kind="stable")
    return tuple(x[order] for x in found)


def _flat(col) -> tuple[np.ndarray, np.ndarray]:
    """Values, as they lie there, and offsets of a list column."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = np.asarray(col.offsets, dtype=np.int64)
    return np.asarray(col.flatten()), off - off[0]


def _ints(col) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column of integers."""
    flat, off = _flat(col)
    return flat.astype(np.int64, copy=False), off


def _lists(flat: np.ndarray, offsets, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets, dtype=np.int32)), pa.array(flat, kind))


def code_table(words: DataFrame) -> np.ndarray:
    """``(first id, len, code - id)`` of each code length, at most 63 rows: codes
    are canonical, so those of a length follow one another like the ids."""
    shift = F.col("code") - F.col("id")
    rows = words.groupBy("len").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.min(shift).alias("a"), F.max(shift).alias("b")).collect()
    rows = sorted((r["x"], r["y"], r["len"], r["a"], r["b"]) for r in rows)
    if any(r[3] != r[4] for r in rows) or any(r[1] >= s[0] for r, s in zip(rows, rows[1:])):
        raise ValueError("codes must be canonical, numbered by their order")
    return np.array([(r[0], r[2], r[3]) for r in rows], dtype=np.int64).reshape(-1, 3)


def codes_of(ids: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their lengths of the words with the given numbers."""
    kind = np.searchsorted(table[:, 0], ids, side="right") - 1
    return ids + table[kind, 2], table[kind, 1]


def folded(batches, table: np.ndarray, most: int, names: dict | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """``(id, off, nodes, n, n1)`` of some words at a time: the counts of a part
    put together and folded up the levels, ``most`` contexts at once or a word."""
    for ids, context, n in sg.words_of(batches, names):
        code, size = codes_of(context, table)
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        off, begin = np.append(first, len(ids)), 0
        while begin < len(first):
            end = max(begin + 1, int(np.searchsorted(off, off[begin] + most, side="right")) - 1)
            x, y = off[begin], off[end]
            row = np.repeat(np.arange(end - begin), np.diff(off[begin:end + 1]))
            row, *flat = fold_rows(row, code[x:y], size[x:y], n[x:y])
            yield ids[first[begin:end]], np.searchsorted(row, np.arange(end - begin + 1)), *flat
            begin = end


def word_targets(cooc: DataFrame, words: DataFrame, named: bool = False) -> DataFrame:
    """``(id, nodes, n, n1)``, ``named`` with ``word`` at the end: per word the nodes its contexts' paths pass, how
    often, and how often they go left there. The counts of a part of the words
    (:func:`skipgram.cooccurrence_lists`) are put together and folded up the levels
    where they lie, ``SLICE_CONTEXTS`` at a time: no row per context and node is
    made, codes come from the numbers of the contexts, and names to the counts, not
    targets to the names. What they are folded from goes along as ``_source``."""
    table, most = code_table(words), SLICE_CONTEXTS

    def run(batches):
        names = {} if named else None
        for ids, ends, *flat in folded(batches, table, most, names):
            word = [pa.array([names[i] for i in ids.tolist()], pa.string())] if named else []
            yield pa.RecordBatch.from_arrays([pa.array(ids), *[_lists(f, ends) for f in flat], *word], ["id", "nodes", "n", "n1", "word"][:4 + len(word)])
    lists = sg.named_lists(cooc._lists, words) if named else cooc._lists
    out = sg.by_part(lists).mapInArrow(run, "id bigint, nodes array<bigint>, n array<bigint>, n1 array<bigint>" + ", word string" * named)
    out._source = cooc._lists, table
    return out


def target_sizes(lists: DataFrame, parts: int, table: np.ndarray) -> tuple[int, int]:
    """How many targets packed counts fold up to, and the greatest count of a
    word. In order of their codes, a context adds the nodes of its path that are
    not on that of the one before."""
    def run(batches):
        for ids, context, n in sg.words_of(batches):
            code, size = codes_of(context, table)
            aligned = code << (hf.MAX_CODE_LEN - size)
            shared = hf.MAX_CODE_LEN - np.frexp((aligned[1:] ^ aligned[:-1]).astype(float))[1] + 1
            first = np.flatnonzero(np.diff(ids, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array([int(size.sum() - shared[ids[1:] == ids[:-1]].sum())]),
                                              pa.array([int(np.add.reduceat(n, first).max())])], ["entries", "top"])
    got = sg.by_part(lists, parts).mapInArrow(run, "entries bigint, top bigint").agg(F.sum("entries"), F.max("top")).first()
    return got[0] or 0, got[1] or 0


def node_targets(targets: DataFrame) -> DataFrame:
    """The rows of :func:`word_targets` one by one: ``(id, node, n, n1)``."""
    return targets.select("id", "n", "n1", F.posexplode("nodes").alias("i", "node")).select(
        "id", "node", F.get("n", "i").alias("n"), F.get("n1", "i").alias("n1"))


WORK = "shard bigint, part bigint, id bigint, a array<bigint>, b array<bigint>, c array<bigint>"


@dataclass
class Work:
    """``rows``, bucketed by shard, and ``need (block, shard, keys)``, bucketed by block."""
    rows: DataFrame
    need: DataFrame
    n_blocks: int

    def drop(self) -> None:
        for table in (self.rows, self.need):
            drop_bucketed(table)


def _work(rows: DataFrame, n_shards: int, n_blocks: int, keys_of: Callable[[pa.Table], np.ndarray],
          naming: Callable[[DataFrame], DataFrame]) -> Work:
    """Writes the rows ``WORK`` and what each shard needs: ``keys_of`` what
    ``naming`` leaves of its rows. Shard numbers are replaced by as many others of
    which each falls into a bucket of its own."""
    spark = rows.sparkSession
    ship_package(spark)
    # about ln n candidates a bucket are needed until each has one
    place = F.pmod(F.hash(F.col("id")), F.lit(n_shards))
    label = {r["b"]: r["id"] for r in spark.range(40 * n_shards + 100).groupBy(place.alias("b")).agg(F.min("id").alias("id")).collect()}
    named = F.element_at(F.array(*[F.lit(int(label[i])) for i in range(n_shards)]), (F.col("shard") + 1).cast("int")) \
        if n_shards <= 4096 and len(label) == n_shards else F.col("shard")
    held = bucketed(rows.withColumn("shard", named.cast("bigint")), "shard", n_shards, "work")

    def need(shard, table):
        keys = np.unique(keys_of(table))
        block = np.mod(keys, n_blocks)
        order = np.argsort(block, kind="stable")
        blocks, first = np.unique(block[order], return_index=True)
        release()
        return pa.table({"block": pa.array(blocks), "shard": pa.array(np.full(len(blocks), shard[0].as_py())),
                         "keys": _lists(keys[order], np.append(first, len(keys)))})
    keys = naming(held).groupBy("shard").applyInArrow(need, "block bigint, shard bigint, keys array<bigint>")
    return Work(held, bucketed(keys, "block", min(n_blocks, n_shards), "needs"), n_blocks)


def shards_for(spark: SparkSession, least: int = 1) -> int:
    return max(SHARDS_PER_CORE * spark.sparkContext.defaultParallelism, least)


def grid_for(shards: int, least: int) -> tuple[int, int]:
    """Parts of the words and of the nodes, at least ``least`` of each and
    ``shards`` cells in all, where that makes an even grid no more than that."""
    side = int(np.sqrt(shards))
    rows = next((r for r in range(side, side // 2, -1) if shards % r == 0), side)
    return max(rows, least), max(-(-shards // rows), least)


def part_of(nodes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each node: heap numbers themselves tell left children from right ones."""
    return ((nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def cells(targets: DataFrame, n_words: int, cell_words: int | None = None) -> Work:
    """Targets ``(id, nodes, n, n1)`` as a grid: words and nodes are dealt by
    their numbers, and a shard is a part of the words by a part of the nodes,
    at most ``cell_words`` of each and about ``CELL_ENTRIES`` pairs of them,
    which bounds a task by what it holds however often words meet. Its rows are
    ``id``, ``a`` nodes, ``b`` n, ``c`` n1, by word."""
    spark = targets.sparkSession
    ship_package(spark)
    most = SLICE_CONTEXTS
    if hasattr(targets, "_source"):     # packed counts are smaller than what they fold up to
        lists, table = targets._source
        held = written(lists, "pairs")
        entries, top = target_sizes(held, lists._parts, table)
        deepest, rows = int(table[:, 1].max(initial=0)), sg.by_part(held, lists._parts)

        def slices(batches):
            return folded(batches, table, most)
    else:
        rows = held = written(targets, "targets")
        entries, top, last = held.agg(F.sum(F.size("nodes").cast("bigint")), F.max(F.array_max("n")), F.max(F.array_max("nodes"))).first()
        entries, top, deepest = entries or 0, top or 0, (last or 0).bit_length()

        def slices(batches):
            for b in batches:
                (nodes, off), (n, _), (n1, _) = (_ints(b.column(i)) for i in (1, 2, 3))
                yield np.asarray(b.column(0)), off, nodes, n, n1
    # a whole number of shards for each core, or the last round leaves most idle
    cores = shards_for(spark)
    across, down = grid_for(cores * max(1, int(np.ceil(entries / CELL_ENTRIES / cores))), -(-n_words // (cell_words or CELL_WORDS)))
    # numbers of 4 bytes where they fit: a task holds them twice
    short, long = (pa.int32(), "int"), (pa.int64(), "bigint")
    kinds = [short if fits else long for fits in (deepest < 32, top < 1 << 31, top < 1 << 31)]

    def run(batches):
        for ids, off, *flat in slices(batches):
            row = np.repeat(np.arange(len(ids)), np.diff(off))
            parts = part_of(flat[0], down)
            by_part = np.argsort(parts.astype(np.uint16) if down < 1 << 16 else parts, kind="stable")
            bounds = np.searchsorted(parts[by_part], np.arange(down + 1))
            for part in range(down):
                mine = by_part[bounds[part]:bounds[part + 1]]
                at = row[mine]
                first = np.flatnonzero(np.diff(at, prepend=-1))
                ends, word = np.append(first, len(mine)), ids[at[first]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((word % across) * down + part), pa.array(np.ones(len(word), np.int64)), pa.array(word),
                     *[_lists(x[mine], ends, k) for x, (k, _) in zip(flat, kinds)]], ["shard", "part", "id", "a", "b", "c"])

    def keys_of(table):
        return np.concatenate([np.asarray(table.column("id")), -np.unique(_flat(table.column("a"))[0]).astype(np.int64)])
    schema = "shard bigint, part bigint, id bigint, " + ", ".join(f"{c} array<{k}>" for c, (_, k) in zip("abc", kinds))
    work = _work(rows.mapInArrow(run, schema), across * down, blocks_for(n_words, spark), keys_of, lambda held: held.select("shard", "id", "a"))
    remove_written(held)
    return work


def paths_of(code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and labels of the paths to the given codes, and where each begins."""
    off = np.concatenate([[0], np.cumsum(size)])
    depth = np.arange(off[-1]) - np.repeat(off[:-1], size)
    c, left = np.repeat(code, size), np.repeat(size, size) - depth
    return (np.int64(1) << depth) + (c >> left), 1 - ((c >> (left - 1)) & 1), off


def replicas_of(docs: DataFrame, words: DataFrame, replicas: int, n_words: int, shards: int | None = None) -> Work:
    """Documents dealt to replicas by a hash of their id, replicas to shards.
    Rows of part 0 hold words ``a``, codes ``b`` and code lengths ``c``, rows
    of part ``1 + replica`` a document's positions ``a`` and words ``b``, ``id``
    being its order. The number of shards follows the cluster and the corpus
    and changes no result."""
    spark = docs.sparkSession
    if shards is None:
        tokens = docs.agg(F.sum(F.size("ids"))).first()[0] or 0
        shards = min(replicas, shards_for(spark, -(-tokens // SHARD_TOKENS)))
    replica = F.pmod(F.xxhash64("doc_id"), F.lit(replicas)).cast("bigint")
    dealt = docs.select(F.pmod(replica, F.lit(shards)).cast("bigint").alias("shard"), (replica + 1).alias("part"),
                        F.xxhash64("doc_id").alias("id"), F.col("pos").alias("a"), F.col("ids").alias("b"))
    none = F.array().cast("array<bigint>")
    used = dealt.select("shard", F.explode("b").alias("id")).distinct().join(words.select("id", "code", "len"), "id")
    paths = used.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("id", "code", "len"))).alias("w")).select(
        "shard", F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("id"), F.col("w.id").alias("a"),
        F.col("w.code").alias("b"), F.col("w.len").cast("array<bigint>").alias("c"))

    def keys_of(head):
        ids, code, size = (_ints(head.column(c))[0] for c in ("a", "b", "c"))
        return np.concatenate([ids, -paths_of(code, size)[0]])
    return _work(paths.unionByName(dealt.withColumn("c", none)), shards, blocks_for(n_words, spark), keys_of, lambda held: held.where("part = 0"))


# --------------------------------------------------------------------- kernels

def sigma(x: np.ndarray) -> np.ndarray:
    """The clipped logistic."""
    with np.errstate(over="ignore"):
        return np.where(x <= -V.LOGISTIC_CLIP, 0.0, np.where(x >= V.LOGISTIC_CLIP, 1.0, 1.0 / (1.0 + np.exp(-x))))


def loss_of(s: np.ndarray, n: np.ndarray, n1: np.ndarray) -> float:
    s = np.clip(s, LOSS_FLOOR, 1 - LOSS_FLOOR)
    return -float(np.sum(n1 * np.log(s) + (n - n1) * np.log(1 - s)))


@dataclass
class Shard:
    """The vectors of one shard, rows by ascending key, and what its work has
    changed: ``change`` and pair-steps ``n`` per row."""
    keys: np.ndarray
    base: np.ndarray

    def __post_init__(self):
        self.change = np.zeros_like(self.base)
        self.n = np.zeros(len(self.keys), dtype=np.int64)
        self.loss, self.steps = 0.0, 0

    def at(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, keys)


def gradient_kernel(shard: Shard, work: pa.Table) -> None:
    """Adds the gradient of rows ``(word id, nodes a, pairs b, of them left
    c)``, some words at a time. Nodes that enough of them meet make a dense
    tile of words by nodes: its scores and both gradients are three matrix
    products, whose cells that hold no pair count nothing. The other nodes are
    taken word by word, then, of some tiles together, node by node."""
    ids = np.asarray(work.column("id"))
    order = np.argsort(ids, kind="stable")
    word = shard.at(ids[order])
    (node, off), (n, _), (n1, _) = (_flat(work.column(c)) for c in "abc")
    size, lengths, rest, kept = len(shard.keys), np.diff(off)[order], [], 0
    col = np.zeros(size, np.int64)
    for i in range(0, len(order), TILE_WORDS):
        here, long = word[i:i + TILE_WORDS], lengths[i:i + TILE_WORDS]
        entries = ragged(off[order[i:i + TILE_WORDS]], long)
        row, at = np.repeat(np.arange(len(here)), long), shard.at(-node[entries].astype(np.int64))
        count, left = n[entries].astype(np.int64), n1[entries].astype(np.int64)
        met = np.bincount(at, minlength=size)
        many = met >= max(2.0, TILE_DENSITY * len(here))
        often = np.flatnonzero(many)
        dense = many[at]
        score, error = np.empty(len(at)), np.empty(len(at))
        wv, nv, grad = shard.base[here], shard.base[often], np.zeros((len(here), shard.base.shape[1]))
        col[often] = np.arange(len(often))
        cell = row[dense] * len(often) + col[at[dense]]
        tile = wv @ nv.T
        score[dense] = tile.ravel()[cell]
        few = ~dense
        ends = np.searchsorted(row[few], np.arange(len(here) + 1)).tolist()
        few_at, few_score, held = at[few], np.empty(int(few.sum())), []
        for w, x, y in zip(wv, ends, ends[1:]):
            held.append(shard.base[few_at[x:y]])
            few_score[x:y] = held[-1] @ w
        score[few] = few_score
        score = sigma(score)
        np.subtract(left, count * score, out=error)
        tile[:] = 0.0
        tile.ravel()[cell] = error[dense]
        shard.change[often] += tile.T @ wv
        few_error = error[few]
        np.matmul(tile, nv, out=grad)
        for g, vecs, x, y in zip(grad, held, ends, ends[1:]):
            g += few_error[x:y] @ vecs
        shard.change[here] += grad
        rest.append((few_at, here[row[few]], few_error))
        shard.n += (np.bincount(here[row], count, minlength=size) + np.bincount(at, count, minlength=size)).astype(np.int64)
        shard.loss += loss_of(score, count, left)
        shard.steps += int(count.sum())
        kept += len(few_at)
        if kept > SLICE_ENTRIES:
            by_nodes(shard, rest)
            rest, kept = [], 0
    if rest:
        by_nodes(shard, rest)


def by_nodes(shard: Shard, rest: list[tuple]) -> None:
    """Adds to each node the words' vectors times the errors of ``(nodes, words, errors)``."""
    node, rows, error = (np.concatenate(x) for x in zip(*rest))
    by_node = np.argsort(node, kind="stable")
    node, rows, error = node[by_node], rows[by_node], error[by_node]
    cut = np.flatnonzero(np.diff(node, prepend=-1))
    for v, x, y in zip(node[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(rows)]):
        shard.change[v] += error[x:y] @ shard.base[rows[x:y]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1``, concatenated."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def pair_slices(docs, half: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(centres, contexts)`` of all pairs, documents ``(pos, ids)`` in order,
    by centre position and then context position: centres as rows (running
    number of the occurrence, word). About ``size`` pairs come at a time,
    however long a document is; the pairs of a centre come together."""
    run, held, number, found = max(1, size // max(1, 2 * half)), [], 0, 0
    for pos, ids in docs:
        for at in range(0, len(ids), run):
            here = pos[at:at + run]
            lo, hi = np.searchsorted(pos, here - half), np.searchsorted(pos, here + half, side="right")
            n = hi - lo
            c = np.repeat(np.arange(at, at + len(here)), n)
            j = np.arange(len(c)) - np.repeat(np.cumsum(n) - n - lo, n)
            c, j = c[j != c], j[j != c]
            held.append((np.stack([number + c, ids[c]], axis=1), ids[j]))
            found += len(c)
            if found >= size:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, found = [], 0
        number += len(ids)
    if found:
        yield tuple(np.concatenate(x) for x in zip(*held))


def by_pair(centres: np.ndarray, contexts: np.ndarray, paths: Paths) -> tuple[np.ndarray, ...]:
    """A step for each pair: the context's path. ``(centre of each step, where
    its nodes begin, nodes, n, n1)``."""
    at = ragged(paths.off[contexts], paths.length[contexts])
    begin = np.concatenate([[0], np.cumsum(paths.length[contexts])])
    return centres, begin, paths.nodes[at], np.ones(len(at)), paths.labels[at].astype(float)


@dataclass
class Runs:
    """Runs of steps of neighbouring centres, each a small dense problem. Run i
    has the ``centres`` from ``begin[i]`` and the ``nodes`` from ``cut[i]`` on,
    those on any of its paths; ``n`` and ``n1`` from ``off[i]`` on hold, steps by
    nodes, the pairs that pass a node and those of them that go left there."""
    centres: np.ndarray
    begin: np.ndarray
    nodes: np.ndarray
    cut: np.ndarray
    n: np.ndarray
    n1: np.ndarray
    off: np.ndarray


def runs_of(words: np.ndarray, most: int) -> np.ndarray:
    """Where runs of steps begin, and the end: a run has at most ``most`` steps
    and no word twice."""
    order = np.argsort(words, kind="stable")
    last = np.full(len(words), -1)
    again = np.flatnonzero(np.diff(words[order]) == 0)
    last[order[again + 1]] = order[again]
    begin = [0]
    for step, before in enumerate(last.tolist()):
        if before >= begin[-1] or step - begin[-1] >= most:
            begin.append(step)
    return np.array([*begin, len(words)])


def by_centre(places: np.ndarray, words: np.ndarray, contexts: np.ndarray, paths: Paths, row: np.ndarray) -> Runs:
    """Runs of steps, a step for the neighbouring pairs of one centre. A run's
    centres share most of their contexts, so its nodes are few."""
    new = np.diff(places, prepend=-1) != 0
    step, words = np.cumsum(new) - 1, words[new]
    begin = runs_of(words, RUN_STEPS)
    run = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[step]
    # the nodes of a run, from its distinct contexts
    pair, here = np.unique(run * len(paths.off) + contexts, return_inverse=True)
    context, length = pair % len(paths.off), paths.length[pair % len(paths.off)]
    width = int(paths.nodes.max()) + 1 if len(paths.nodes) else 1
    at = ragged(paths.off[context], length)
    key, col = np.unique(np.repeat(pair // len(paths.off), length) * width + paths.nodes[at], return_inverse=True)
    cut = np.searchsorted(key // width, np.arange(len(begin)))
    size = np.diff(cut)
    off = np.concatenate([[0], np.cumsum(np.diff(begin) * size)])
    # per pair the cells of its path, runs one after the other, steps by nodes
    ends = np.cumsum(length)
    each = ragged((ends - length)[here], length[here])
    cell = np.repeat(off[run] + (step - begin[run]) * size[run] - cut[run], length[here]) + col[each]
    n = np.bincount(cell, minlength=off[-1]).astype(float)
    n1 = np.bincount(cell, paths.labels[at][each], minlength=off[-1])
    return Runs(row[words], begin, key % width, cut, n, n1, off)


def sgd_runs(vecs: np.ndarray, runs: Runs, lr: float) -> np.ndarray:
    """The steps of all runs on ``vecs``, in order, as :func:`sgd` takes them;
    the scores before each, with a minus sign. While no word comes twice, a
    vector after some steps is what it was plus a combination of the run's
    first vectors: a node has got ``g`` times the centre of each step, a centre
    ``g`` times its nodes as they were then. So products are taken of the first
    vectors, and only the numbers ``g`` step by step."""
    clip, exp, take, clipped = V.LOGISTIC_CLIP, np.exp, vecs.take, False
    less, out, later = lr * runs.n, np.empty(len(runs.n)), np.tri(RUN_STEPS, k=-1)
    bounds = zip(*(x.tolist() for x in (runs.begin[:-1], runs.begin[1:], runs.cut[:-1], runs.cut[1:], runs.off[:-1], runs.off[1:])))
    for x, y, u, v, a, b in bounds:
        centres, nodes, steps = runs.centres[x:y], runs.nodes[u:v], range(y - x)
        w, nv, fewer = take(centres, 0), take(nodes, 0), less[a:b].reshape(y - x, -1)
        first, dots = nv @ w.T, w @ -w.T
        while True:
            scores = out[a:b].reshape(y - x, -1)
            np.negative(first.T, out=scores)
            g = lr * runs.n1[a:b].reshape(y - x, -1)
            for t, s, gt, low in zip(steps, scores, g, fewer):
                if t:
                    s += dots[t, :t] @ g[:t]
                e = exp(s)
                if clipped:
                    np.putmask(e, s >= clip, np.inf)
                    np.putmask(e, s <= -clip, 0.0)
                e += 1.0
                gt -= low / e
            # the clip is tried when scores reach it, and until none does
            reached = v > u and max(scores.max(), -scores.min()) >= clip
            if clipped or not reached:
                clipped = reached
                break
            clipped = True
        vecs[nodes] = nv + g.T @ w
        w += g @ nv + ((g @ g.T) * later[:y - x, :y - x]) @ w
        vecs[centres] = w
    return out


def sgd(vecs: np.ndarray, centres: np.ndarray, begin: np.ndarray, nodes: np.ndarray, n: np.ndarray, n1: np.ndarray,
        lr: float) -> np.ndarray:
    """Steps on ``vecs``, in order; the scores before each. The nodes of a step
    are distinct and updated from its centre's vector before the step, the
    centre from their vectors before it."""
    clip, take, rows = V.LOGISTIC_CLIP, vecs.take, list(vecs)
    scores = np.empty(len(nodes))
    most, less = lr * n1, lr * n
    for c, x, y in zip(centres.tolist(), begin[:-1].tolist(), begin[1:].tolist()):
        at, w = nodes[x:y], rows[c]
        nv = take(at, 0)
        s = scores[x:y] = nv @ w
        if y > x and np.abs(s).max() >= clip:
            g = most[x:y] - less[x:y] * sigma(s)
        else:
            e = np.exp(-s)
            e += 1.0
            g = most[x:y] - less[x:y] / e
        up = g @ nv
        nv += g[:, None] * w
        vecs[at] = nv
        w += up
    return scores


@dataclass
class Paths:
    """Paths of a shard's words: rows of their nodes and labels, words one after the other."""
    nodes: np.ndarray
    labels: np.ndarray
    off: np.ndarray
    length: np.ndarray


def replica_kernel(shard: Shard, work: pa.Table, lr: float, half: int, size: int, unit: str) -> None:
    """SGD in each replica of the shard, from the same vectors, a step for each
    ``unit`` in order of documents and positions."""
    part = np.asarray(work.column("part"))
    order = np.lexsort([np.asarray(work.column("id")), part])
    (a, a_off), (b, b_off), (c, c_off) = (_ints(work.column(x)) for x in "abc")
    heads = order[part[order] == 0]
    words, code, length = (np.concatenate([x[o[i]:o[i + 1]] for i in heads] or [np.zeros(0, np.int64)])
                           for x, o in ((a, a_off), (b, b_off), (c, c_off)))
    nodes, labels, off = paths_of(code, length)
    row, nodes = shard.at(words), shard.at(-nodes)
    paths = Paths(nodes, labels, off[:-1], length)
    vecs = shard.base.copy()
    docs = order[part[order] > 0]
    cut = np.flatnonzero(np.diff(part[docs], prepend=-1))
    for x, y in zip(cut, [*cut[1:], len(docs)]):
        texts = ((a[a_off[i]:a_off[i + 1]], np.searchsorted(words, b[b_off[i]:b_off[i + 1]])) for i in docs[x:y])
        as_centre, as_context, loss = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0.0
        for place, context in pair_slices(texts, half, size):
            centre = place[:, 1]
            if unit == "centre":
                runs = by_centre(place[:, 0], centre, context, paths, row)
                scores, hit = -sgd_runs(vecs, runs, lr), runs.n > 0
                loss += loss_of(sigma(scores[hit]), runs.n[hit], runs.n1[hit])
            else:
                _, begin, at, n, n1 = by_pair(place[:, 0], context, paths)
                loss += loss_of(sigma(sgd(vecs, row[centre], begin, at, n, n1, lr)), n, n1)
            as_centre += np.bincount(centre, length[context], minlength=len(words)).astype(np.int64)
            as_context += np.bincount(context, minlength=len(words))
        used = np.flatnonzero(as_context)
        touched = np.unique(np.concatenate([row[as_centre > 0], nodes[ragged(off[:-1][used], length[used])]]))
        for i in range(0, len(touched), BLOCK_KEYS):     # few rows at a time stay in the cache
            some = touched[i:i + BLOCK_KEYS]
            base = shard.base[some]
            moved = vecs[some]
            moved -= base
            moved /= QUANTUM
            shard.change[some] += np.rint(moved, out=moved) * QUANTUM
            vecs[some] = base
        shard.n[row] += as_centre
        np.add.at(shard.n, nodes, np.repeat(as_context, length))
        shard.loss += round(loss / LOSS_QUANTUM) * LOSS_QUANTUM
        shard.steps += int(as_centre.sum())


# ------------------------------------------------------------------ iterations

CHANGES = "block bigint, shard bigint, keys array<bigint>, change array<double>, n array<bigint>"


def delivered(work: Work, params: DataFrame) -> DataFrame:
    """``(shard, block, keys, vecs)``: to every shard the vectors it needs."""
    def pick(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "block": pa.array([], pa.int64()),
                             "keys": pa.array([], pa.list_(pa.int64())), "vecs": pa.array([], pa.list_(pa.float64()))})
        have = _ints(left.column("keys"))[0]
        vecs = np.asarray(left.column("vecs").combine_chunks().flatten()).reshape(len(have), -1)
        keys, off = _ints(right.column("keys"))
        return pa.table({"shard": right.column("shard"), "block": right.column("block"), "keys": right.column("keys"),
                         "vecs": _lists(vecs[np.searchsorted(have, keys)].ravel(), off * vecs.shape[1])})
    return params.select("block", "keys", "vecs").groupBy("block").cogroup(work.need.groupBy("block")).applyInArrow(
        pick, "shard bigint, block bigint, keys array<bigint>, vecs array<double>")


def changes(work: Work, params: DataFrame, kernel: Callable[[Shard, pa.Table], None]) -> DataFrame:
    """What the kernel changes at ``params``, a row per block and shard, and
    per shard a row of block -1 with the loss and the number of steps."""
    ship_package(params.sparkSession)

    def run(key, rows, vectors):
        keys, off = _ints(vectors.column("keys"))
        flat = _flat(vectors.column("vecs"))[0]
        order = np.argsort(keys, kind="stable")
        shard = Shard(keys[order], flat.reshape(len(keys), -1)[order] if len(keys) else np.zeros((0, 1)))
        blocks = [*vectors.column("block").to_pylist(), LOSS_BLOCK]
        del flat, vectors
        kernel(shard, rows)
        del rows, shard.base
        place = np.empty_like(order)
        place[order] = np.arange(len(order))     # in the order they came: by block
        hit = shard.n[place] > 0
        ends = np.concatenate([[0], np.cumsum(hit)])[off]
        dim = shard.change.shape[1]
        change = np.empty(ends[-1] * dim + 2)
        np.take(shard.change, place[hit], axis=0, out=change[:-2].reshape(-1, dim), mode="clip")
        change[-2:] = shard.loss, shard.steps
        n = shard.n[place[hit]]
        del shard
        release()
        return pa.table({
            "block": pa.array(blocks, pa.int64()), "shard": pa.array([key[0].as_py()] * len(blocks), pa.int64()),
            "keys": _lists(keys[hit], [*ends, ends[-1]]),
            "change": _lists(change, [*(ends * dim), ends[-1] * dim + 2]),
            "n": _lists(n, [*ends, ends[-1]])})
    return work.rows.groupBy("shard").cogroup(delivered(work, params).groupBy("shard")).applyInArrow(run, CHANGES)


def gradient(work: Work, params: DataFrame) -> DataFrame:
    """The full-batch gradient at ``params``, as :func:`changes`."""
    return changes(work, params, gradient_kernel)


def local_sgd(work: Work, params: DataFrame, lr: float = LEARNING_RATE, half: int = sg.HALF_WINDOW, unit: str = "centre") -> DataFrame:
    """One round of SGD on every replica from the same parameters, as
    :func:`changes`. A step takes all pairs of a centre (``unit`` "centre") or
    one ("pair"). A task holds its shard's vectors and tokens; of the pairs,
    ``SLICE_PAIRS`` are laid out at once."""
    size = SLICE_PAIRS
    return changes(work, params, lambda shard, rows: replica_kernel(shard, rows, lr, half, size, unit))


def _summed(found: pa.Table, keys: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Changes and steps of a block added up, shard by shard."""
    total, n = np.zeros((len(keys), dim)), np.zeros(len(keys), dtype=np.int64)
    found = found.take(pa.array(np.argsort(np.asarray(found.column("shard")), kind="stable")))
    change = np.asarray(found.column("change").combine_chunks().flatten()) if found.num_rows else np.zeros(0)
    (touched, off), (steps, _) = (_ints(found.column(c)) if found.num_rows else (np.zeros(0, np.int64),) * 2 for c in ("keys", "n"))
    change = change.reshape(len(touched), -1)
    for x, y in zip(off[:-1], off[1:]):
        at = np.searchsorted(keys, touched[x:y])
        total[at] += change[x:y]
        n[at] += steps[x:y]
    return total, n


def stepped(params: DataFrame, found: DataFrame, step: Callable) -> DataFrame:
    """The next parameters: ``step(vecs, acc, change)`` gives a block's vectors
    and history after the summed changes. Block -1 takes the loss and steps, too."""
    ship_package(params.sparkSession)

    def run(key, left, right):
        if key[0].as_py() == LOSS_BLOCK:
            right = right.take(pa.array(np.argsort(np.asarray(right.column("shard")), kind="stable"))) if right.num_rows else right
            rows = np.asarray(right.column("change").combine_chunks().flatten()).reshape(-1, 2) if right.num_rows else np.zeros((0, 2))
            past = np.asarray(left.column("vecs").combine_chunks().flatten()).tolist()
            return pa.table({"block": left.column("block"), "keys": left.column("keys"),
                             "vecs": pa.array([past + rows.sum(axis=0).tolist()], pa.list_(pa.float64())), "acc": left.column("acc")})
        keys = _ints(left.column("keys"))[0]
        vecs, acc = (np.asarray(left.column(c).combine_chunks().flatten()).reshape(len(keys), -1) for c in ("vecs", "acc"))
        total, _ = _summed(right, keys, vecs.shape[1])
        vecs, acc = step(vecs, acc if acc.size else np.zeros_like(vecs), total)
        return pa.table({"block": left.column("block"), "keys": left.column("keys"),
                         "vecs": _lists(vecs.ravel(), [0, vecs.size]), "acc": _lists(acc.ravel(), [0, acc.size])})
    return params.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, PARAMS)


def adagrad(lr: float) -> Callable:
    """Each component moves by ``lr * g / sqrt(acc)``, ``acc`` being the sum of
    its squared gradients so far."""
    def step(vecs, acc, grad):
        acc = acc + grad * grad
        with np.errstate(invalid="ignore", divide="ignore"):
            return vecs + np.where(grad == 0, 0.0, lr * grad / np.sqrt(acc)), acc
    return step


def averaging(replicas: int) -> Callable:
    """``base + sum of changes / replicas``; untouched rows stay."""
    if replicas <= 0:
        raise ValueError("replica count must be positive")

    def step(vecs, acc, change):
        return vecs + change / replicas, np.zeros((0, 0))
    return step


def hs_gradient(targets: DataFrame, params: DataFrame, cell_words: int | None = None) -> DataFrame:
    """``(kind, id, grad, n)`` for rows ``(kind, id, vec)``: for a node the sum
    over its words of (n1 - n sigma) times the word's vector, for a word the
    same with the nodes', ``n`` the pair-steps behind it. Targets as
    :func:`word_targets` gives them."""
    n_words = params.where("kind = 'word'").count()
    work = cells(targets, n_words, cell_words)
    params = written(packed(params, work.n_blocks), "params")
    found = gradient(work, params)

    def run(left, right):
        keys = _ints(left.column("keys"))[0]
        dim = len(left.column("vecs").combine_chunks().flatten()) // max(1, len(keys))
        total, n = _summed(right, keys, dim)
        hit = n > 0
        kind = np.where(keys[hit] < 0, "node", "word")
        return pa.table({"kind": pa.array(kind.tolist(), pa.string()), "id": pa.array(np.abs(keys[hit])),
                         "grad": _lists(total[hit].ravel(), np.arange(hit.sum() + 1) * dim), "n": pa.array(n[hit])})
    real = F.col("block") != LOSS_BLOCK
    return params.where(real).groupBy("block").cogroup(found.where(real).groupBy("block")).applyInArrow(
        run, "kind string, id bigint, grad array<double>, n bigint")


# -------------------------------------------------------------------- trainers

@dataclass
class Fit:
    """A trained model: blocks of parameters, the words they belong to, the
    rounds of an iteration, and report rows, whose words are keys."""
    params: DataFrame
    words: DataFrame
    rounds: int
    report: list[tuple]

    def rows(self) -> DataFrame:
        """``(kind, id, vec)``."""
        return unpacked(self.params)

    @property
    def losses(self) -> list[float]:
        """The mean loss of each iteration's pair-steps, each before its step,
        of several rounds their mean."""
        past = np.array(self.params.where(F.col("block") == LOSS_BLOCK).first()["vecs"]).reshape(-1, 2)
        mean = np.divide(past[:, 0], past[:, 1], out=np.zeros(len(past)), where=past[:, 1] > 0)
        return mean.reshape(-1, self.rounds).mean(axis=1).tolist()


def _next(fit: Fit, new: DataFrame) -> None:
    """Writes the next parameters, in one job, and removes the last ones."""
    old, fit.params = fit.params, written(new, "params")
    remove_written(old)


def sync_step(params: DataFrame, work: Work, lr: float) -> DataFrame:
    """Rows ``(kind, id, vec)`` after one synchronous step without history."""
    start = written(packed(params, work.n_blocks), "params")
    return unpacked(stepped(start, gradient(work, start), adagrad(lr)))


def fit_sync(corpus: DataFrame, iters: int = ITERATIONS, dim: int = DIM, lr: float = LEARNING_RATE,
             seed: int = 0, schedule: str = "constant", half: int = sg.HALF_WINDOW,
             cell_words: int | None = None, probes: Probes | None = None, prep: Prepared | None = None) -> Fit:
    """Synchronous full-batch training. ``probes``: report on them after every
    iteration."""
    prep = prep or prepare(corpus)
    work = cells(word_targets(cooccurrence(prep, half), prep.words), prep.words.count(), cell_words)
    fit = Fit(written(packed(init_params(prep, dim, seed), work.n_blocks), "params"), prep.words, 1, [])
    for it in range(iters):
        rate = learning_rate(it, iters, lr, schedule)
        _next(fit, stepped(fit.params, gradient(work, fit.params), adagrad(rate)))
        if probes:
            fit.report += probes.rows(it + 1, fit)
    work.drop()
    return fit


def assign_batches(corpus: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Adds ``batch`` in [0, n): md5 of ``doc_id:seed``, the same under any partitioning."""
    return corpus.withColumn("batch", F.pmod(hash32(keyed(F.col("doc_id"), seed)), F.lit(n)))


def write_batches(corpus: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The documents written by batch, so that :func:`select_batch` reads the
    files of one batch only."""
    spark = corpus.sparkSession
    path = scratch_path(spark, "batches")
    dealt = assign_batches(corpus, n, seed)
    dealt.write.partitionBy("batch").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def select_batch(corpus: DataFrame, m: int) -> DataFrame:
    """Documents of mini-batch ``m`` (after ``assign_batches`` or ``write_batches``)."""
    return corpus.where(F.col("batch") == F.lit(m)).drop("batch")


def fit_local(corpus: DataFrame, iters: int = ITERATIONS, replicas: int = REPLICAS, dim: int = DIM,
              lr: float = LEARNING_RATE, seed: int = 0, schedule: str = "constant", batches: int = 1,
              half: int = sg.HALF_WINDOW, probes: Probes | None = None, prep: Prepared | None = None,
              shards: int | None = None, unit: str = "centre") -> Fit:
    """The reference's scheme: per iteration and mini-batch, local SGD on every
    replica from the same parameters, then averaging over the replicas, a
    setting that does not depend on the corpus."""
    prep = prep or prepare(corpus)
    n_words = prep.words.count()
    docs = write_batches(prep.docs, batches, seed)
    works = [replicas_of(select_batch(docs, b), prep.words, replicas, n_words, shards) for b in range(batches)]
    n_blocks = blocks_for(n_words, prep.words.sparkSession)
    fit = Fit(written(packed(init_params(prep, dim, seed), n_blocks), "params"), prep.words, batches, [])
    for it in range(iters):
        rate = learning_rate(it, iters, lr, schedule)
        for work in works:
            _next(fit, stepped(fit.params, local_sgd(work, fit.params, rate, half, unit), averaging(replicas)))
        if probes:
            fit.report += probes.rows(it + 1, fit)
    for work in works:
        work.drop()
    return fit


# ---------------------------------------------------------- export and report

def vectors_of(fit: Fit) -> DataFrame:
    """``(word, count, vec)`` of the trained words."""
    return fit.words.select("word", "count", "id").join(fit.rows().where("kind = 'word'").select("id", "vec"), "id") \
        .select("word", "count", "vec")


@dataclass
class Probes:
    """Words whose neighbours, and triples ``(a, b, c)`` whose analogies, are
    reported after every iteration. Both are short lists given by the caller;
    a task sends back k keys for each, and words are looked up in the end."""
    words: list[str]
    triples: list[tuple[str, str, str]]
    k: int = 10

    def rows(self, iteration: int, fit: Fit) -> list[tuple]:
        """``(iteration, kind, query, rank, key, value)`` after an iteration:
        neighbours and answers."""
        out = []
        wanted = {*self.words, *(w for t in self.triples for w in t)}
        if not hasattr(self, "keys"):
            self.keys = {r["word"]: r["id"] for r in fit.words.where(F.col("word").isin(*wanted)).collect()} if wanted else {}
        if not self.keys:
            return out
        if not hasattr(self, "blocks"):     # which never change
            asked = F.array(*[F.lit(k).cast("bigint") for k in self.keys.values()])
            self.blocks = [r["block"] for r in fit.params.where(F.arrays_overlap("keys", asked)).select("block").collect()]
        vec = {}
        for r in fit.params.where(F.col("block").isin(*self.blocks)).select("keys", "vecs").collect():
            some = np.array(r["vecs"]).reshape(len(r["keys"]), -1)
            vec |= {k: v for k, v in zip(r["keys"], some) if k in self.keys.values()}
        known = {w: vec[k] for w, k in self.keys.items()}
        asked = [("nearest", w, known[w], set()) for w in self.words if w in known]
        asked += [("analogy", " ".join(t), known[t[0]] - known[t[1]] + known[t[2]], {self.keys[w] for w in t})
                  for t in self.triples if all(w in known for w in t)]
        if not asked:
            return out
        found = self._nearest(fit.params, np.stack([q[2] for q in asked]), max(self.k, 1) + 3)
        for i, (kind, name, _, skip) in enumerate(asked):
            best = sorted((-s, k) for q, k, s in found if q == i and k not in skip)[:self.k if kind == "nearest" else 1]
            out += [(iteration, kind, name, rank, k, -s) for rank, (s, k) in enumerate(best, 1)]
        return out

    @staticmethod
    def _nearest(params: DataFrame, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """Per task and query the k words with the greatest cosine; zero vectors are no answers."""
        unit = queries / np.maximum(np.sqrt((queries * queries).sum(axis=1)), 1e-300)[:, None]

        def run(batches):
            keys, sims = np.zeros(0, np.int64), np.zeros((0, len(unit)))
            for b in batches:
                here, off = _ints(b.column(0))
                vecs = np.asarray(b.column(1).flatten()).reshape(len(here), -1) if len(here) else np.zeros((0, unit.shape[1]))
                size = np.sqrt((vecs * vecs).sum(axis=1))
                word = np.flatnonzero((here >= 0) & (size > 0))
                keys = np.concatenate([keys, here[word]])
                sims = np.concatenate([sims, vecs[word] @ unit.T / size[word, None]])
                best = np.unique(np.concatenate([np.lexsort([keys, -sims[:, q]])[:k] for q in range(len(unit))] or [[]])).astype(int)
                keys, sims = keys[best], sims[best]
            q, i = np.meshgrid(np.arange(len(unit)), np.arange(len(keys)), indexing="ij")
            yield pa.RecordBatch.from_arrays([pa.array(q.ravel()), pa.array(keys[i.ravel()]), pa.array(sims[i.ravel(), q.ravel()])],
                                             ["q", "key", "sim"])
        ship_package(params.sparkSession)
        rows = params.where(F.col("block") != LOSS_BLOCK).select("keys", "vecs").mapInArrow(run, "q bigint, key bigint, sim double")
        return [(r["q"], r["key"], r["sim"]) for r in rows.collect()]


def training_report(fit: Fit) -> DataFrame:
    """``(iteration, kind, query, rank, word, value)``: the mean loss, nearest
    words and analogy answers of every iteration."""
    losses = [(i, "loss", None, None, None, x) for i, x in enumerate(fit.losses, 1)]
    rows = fit.params.sparkSession.createDataFrame(
        losses + fit.report, "iteration int, kind string, query string, rank bigint, key bigint, value double")
    names = fit.words.select(F.col("id").alias("key"), "word")
    return rows.join(names, "key", "left").select("iteration", "kind", "query", "rank", "word", "value")
