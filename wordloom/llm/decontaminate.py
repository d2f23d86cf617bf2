"""Benchmark decontamination: rare n-grams of the test items seed candidates,
Smith-Waterman alignment scores them.

Texts are lower-cased and read as words (letters, digits, underscore). The
n-grams are pairs of neighbouring words of an item; a document holds a pair
where its words stand next to each other or with one word between them. One
pass over the corpus counts how often it holds each pair.

**Seeds.** An alignment that scores ``s`` of an item of ``L`` words, over ``l``
of them and with ``M`` matched, pays 1 for each of the ``l - M`` unmatched and
for each foreign word, ``2 (M - s L)`` in all at most. So ``M >= (2 s L + l) /
3``; at least ``2 M - l - 1`` neighbouring pairs are matched whole, and of these
at least ``(4 s - 1) L / 3 - 1`` stand in the document with one foreign word
between them or none: a third of the pairs at a score of one half. That leaves
room to choose: the pairs rarest in the corpus are the item's seeds, as many as
make sure that half of that number are still found, all within ``(3 - 2 s) L``
words. A stretch with so many seeds of an item is a candidate; no alignment
that reaches the score is missed, whatever was edited and however often the
item is copied. Nothing is capped. An item of one word is its own seed.

**Scores.** A second pass joins documents to items on the seeds and aligns each
item with the stretch around the candidates (match 2, mismatch -1, gap -1).
The score is the alignment's share of the item's own best, so 1 is a whole
copy and edits, insertions and deletions lower it gradually. A few common words
may be half of a short item: those of fewer than :data:`SHORT_ITEM` words also
need :data:`RUN_WORDS` words in a row unchanged, the whole item if it is shorter.

Items are the query set: they are taken in blocks of at most
:data:`BLOCK_CHARS` characters, each broadcast to the workers. A document is
handled within its own row, so shared passages load no task more than others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import in_arrow
from wordloom.llm.words import ragged, split_words, texts_of, utf8_bytes

SHORT_ITEM = 12
RUN_WORDS = 3
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_CHARS = 4_000_000
SLICE_BYTES = 4 << 20       # texts of a batch are handled this many bytes at a time, a longer one alone
WORD = re.compile(r"\w+")


def word_ids(texts: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words (-1 if not in ``known``) and each text's offset."""
    w = split_words(pc.utf8_lower(texts))
    lists = [[known.get(x, -1) for x in WORD.findall(s)] for s in w.distinct]
    n = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    pool = np.fromiter((i for one in lists for i in one), dtype=np.int64, count=int(n.sum()))
    per = n[w.index]
    ids = pool[ragged((np.cumsum(n) - n)[w.index], per)]
    return ids, np.concatenate([[0], np.cumsum(per)])[w.offsets]


def slices(batches, col: int):
    """Arrow batches cut so that the texts of one take about ``SLICE_BYTES``."""
    for b in batches:
        bounds = utf8_bytes(texts_of(b.column(col)))[1]
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, side="right")) - 1)
            yield b.slice(at, end - at)
            at = end


def item_words(text: str) -> list[str]:
    """The words of one item, cut as :func:`word_ids` cuts documents."""
    lower = pc.utf8_lower(pa.array([text], pa.large_string()))
    return [x for s in pc.ascii_split_whitespace(lower)[0].as_py() for x in WORD.findall(s)]


def _keys(first: np.ndarray, second: np.ndarray, n_words: int) -> np.ndarray:
    return first * (n_words + 1) + second


@dataclass
class Index:
    """A block of items: their word ids, their pairs as sorted keys (of a
    one-word item the word with itself), the pair at each place of an item, and
    once they are chosen the seeds. Pair ``g`` seeds the items
    ``seed_item[seed_at[g]:seed_at[g + 1]]``; ``need`` and ``reach`` are how many
    of an item's seeds a candidate holds and within how many words."""
    item_ids: list
    words: list[np.ndarray]
    known: dict[str, int]
    pairs: np.ndarray
    places: list[np.ndarray]
    lone: np.ndarray
    seed_at: np.ndarray | None = None
    seed_item: np.ndarray | None = None
    need: np.ndarray | None = None
    reach: np.ndarray | None = None

    def hits(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ids`` at which a pair of the block begins, and its number."""
        if not len(self.pairs):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(ids >= 0)
        end = offsets[np.searchsorted(offsets, at, side="right")]
        found, which = [], []
        for gap in (1, 2):
            inside = at[at + gap < end]
            inside = inside[ids[inside + gap] >= 0]
            key = _keys(ids[inside], ids[inside + gap], len(self.known))
            where = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            same = self.pairs[where] == key
            found.append(inside[same])
            which.append(where[same])
        if len(self.lone):
            alone = at[np.isin(ids[at], self.lone)]
            found.append(alone)
            which.append(np.searchsorted(self.pairs, _keys(ids[alone], ids[alone], len(self.known))))
        found, which = np.concatenate(found), np.concatenate(which)
        order = np.argsort(found, kind="stable")
        return found[order], which[order]

    def candidates(self, ids: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(row, item, first, last)``: stretches of words, as places in
        ``ids``, that hold the needed seeds of an item; neighbours joined."""
        at, gram = self.hits(ids, offsets)
        n = np.diff(self.seed_at)[gram]
        item = self.seed_item[ragged(self.seed_at[gram], n)]
        at = np.repeat(at, n)
        row = np.searchsorted(offsets, at, side="right") - 1
        pair = row * len(self.words) + item
        order = np.argsort(pair, kind="stable")
        pair, at, item, row = pair[order], at[order], item[order], row[order]
        last = np.arange(len(at)) + self.need[item] - 1
        inside = np.flatnonzero(last < len(at))
        far = last[inside]
        inside = inside[(pair[far] == pair[inside]) & (at[far] - at[inside] < self.reach[item[inside]])]
        if not len(inside):
            return []
        lo, hi = at[inside], at[last[inside]]
        # stretches of one pair come by their beginnings
        new = np.flatnonzero(np.r_[True, (pair[inside][1:] != pair[inside][:-1]) | (lo[1:] - hi[:-1] > self.reach[item[inside][1:]])])
        return list(zip(row[inside][new].tolist(), item[inside][new].tolist(), lo[new].tolist(),
                        np.maximum.reduceat(hi, new).tolist()))


def make_index(rows: list[tuple]) -> Index:
    """``rows``: (item id, text). Items without a word match nothing."""
    known: dict[str, int] = {}
    ids, words = [], []
    for item, text in rows:
        ws = item_words(text) if text else []
        if ws:
            ids.append(item)
            words.append(np.array([known.setdefault(w, len(known)) for w in ws], dtype=np.int64))
    keys = [_keys(w[:-1], w[1:], len(known)) if len(w) > 1 else _keys(w, w, len(known)) for w in words]
    pairs = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    lone = np.array(sorted({int(w[0]) for w in words if len(w) == 1}), dtype=np.int64)
    return Index(ids, words, known, pairs, [np.searchsorted(pairs, k) for k in keys], lone)


def choose_seeds(index: Index, counts: np.ndarray, min_score: float = MIN_SCORE) -> None:
    """Marks the rarest pairs of each item, the first of equals, and how many
    of them an alignment of the least score must hold."""
    gram, item, need, reach = [], [], [], []
    for i, (word, place) in enumerate(zip(index.words, index.places)):
        n = len(word)
        sure = min(len(place), max(1, ceil((4 * min_score - 1) * n / 3 - 1 - 1e-9)))
        kept = max(1, sure // 2)
        rare = np.argsort(counts[place], kind="stable")[:len(place) - sure + kept]
        gram.append(place[rare])
        item.append(np.full(len(rare), i))
        need.append(kept)
        reach.append(ceil(n * (3 - 2 * min_score) - 1e-9) + 1)
    gram, item = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (gram, item))
    order = np.argsort(gram, kind="stable")
    index.seed_item = item[order]
    index.seed_at = np.searchsorted(gram[order], np.arange(len(index.pairs) + 1))
    index.need, index.reach = np.array(need, dtype=np.int64), np.array(reach, dtype=np.int64)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best local score and the last item and window words of
    an alignment that has it. Rows are items' words; gaps along a row are a
    running maximum."""
    j = np.arange(len(window) + 1) * -GAP
    h = np.zeros(len(window) + 1, dtype=np.int64)
    best, at = 0, (0, 0)
    for i, word in enumerate(item):
        x = np.maximum(h + GAP, 0)
        x[1:] = np.maximum(x[1:], h[:-1] + np.where(window == word, MATCH, MISMATCH))
        h = np.maximum.accumulate(x + j) - j
        k = int(h.argmax())
        if h[k] > best:
            best, at = int(h[k]), (i, k - 1)
    return best, at[0], at[1]


def _run_kept(item: np.ndarray, stretch: np.ndarray) -> bool:
    """Whether a run of the item's words stands unchanged in a stretch."""
    n = min(RUN_WORDS, len(item))
    runs = {tuple(item[k:k + n].tolist()) for k in range(len(item) - n + 1)}
    words = stretch.tolist()
    return any(tuple(words[k:k + n]) in runs for k in range(len(words) - n + 1))


def matches(index: Index, ids: np.ndarray, offsets: np.ndarray, min_score: float) -> list[tuple]:
    """(row, item number, score, first word, last word) of each document and
    item that align at ``min_score`` or better; the best place of each pair."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r, item, first, last in index.candidates(ids, offsets):
        word, begin, reach = index.words[item], int(offsets[r]), int(index.reach[item])
        lo, hi = max(begin, first - reach), min(int(offsets[r + 1]), last + reach + 1)
        score, i, j = align(word, ids[lo:hi])
        if score < min_score * MATCH * len(word) or score <= best.get((r, item), (0,))[0]:
            continue
        back = align(word[:i + 1][::-1], ids[lo:lo + j + 1][::-1])
        start = lo + j - back[2]
        if len(word) >= SHORT_ITEM or _run_kept(word, ids[start:lo + j + 1]):
            best[r, item] = (score, start - begin, lo + j - begin)
    return [(r, item, score / (MATCH * len(index.words[item])), x, y) for (r, item), (score, x, y) in best.items()]


def blocks(items: DataFrame, item_id: str, item_text: str) -> list[list[tuple]]:
    """The items in blocks that fit a broadcast."""
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_CHARS))
    for b in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda x: (str(x[0]), x[1]))


def seeded(docs: DataFrame, text_col: str, rows: list[tuple], min_score: float) -> Index:
    """The index of a block, its seeds chosen by counts over all of ``docs``."""
    index = make_index(rows)
    bc = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches):
        total = np.zeros(len(bc.value.pairs), dtype=np.int64)
        for b in slices(batches, 0):
            total += np.bincount(bc.value.hits(*word_ids(texts_of(b.column(0)), bc.value.known))[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "n"])

    counts = np.zeros(len(index.pairs), dtype=np.int64)
    per_pair = in_arrow(docs.select(text_col), count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    for r in per_pair.collect():       # a row per pair of the block at most
        counts[r["pair"]] = r["n"]
    bc.unpersist()
    choose_seeds(index, counts, min_score)
    return index


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document and item found in it: both ids, ``score`` (0 to
    1), ``first_word`` and ``last_word`` of the aligned stretch.

    Null and empty texts match nothing; repeated rows give repeated matches;
    no items, no rows. The larger the items, the more blocks, each a pass.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    out = None
    for rows in blocks(items, item_id, item_text):
        bc = spark.sparkContext.broadcast(seeded(docs, text_col, rows, min_score))

        def run(batches, bc=bc):
            for b in slices(batches, 1):
                ids, offsets = word_ids(texts_of(b.column(1)), bc.value.known)
                m = matches(bc.value, ids, offsets, min_score)
                cols = list(zip(*m)) if m else [()] * 5
                item = pa.array([bc.value.item_ids[i] for i in cols[1]])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[0], pa.int64())), item if len(item) else pa.nulls(0, pa.int64()),
                     *(pa.array(c, t) for c, t in zip(cols[2:], (pa.float64(), pa.int64(), pa.int64())))],
                    ["id", "item", "score", "first_word", "last_word"])

        part = in_arrow(docs.select(id_col, text_col), run,
                           f"id {kind}, item {item_kind}, score double, first_word bigint, last_word bigint")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_id})


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text",
                    item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows in which an item is found; no shuffle."""
    spark, schema = docs.sparkSession, docs.schema
    place = docs.columns.index(text_col)
    for rows in blocks(items, item_id, item_text):
        bc = spark.sparkContext.broadcast(seeded(docs, text_col, rows, min_score))

        def run(batches, bc=bc):
            for b in slices(batches, place):
                ids, offsets = word_ids(texts_of(b.column(place)), bc.value.known)
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[m[0] for m in matches(bc.value, ids, offsets, min_score)]] = False
                yield b.filter(pa.array(keep))

        docs = in_arrow(docs, run, schema)
    return docs
