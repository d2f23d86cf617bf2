"""Alignment of two tokenizers' ids over the same texts.

A is a byte-level BPE of the ``tokenizers`` library, applied to a space and
the text; B a ``sentencepiece`` BPE, which puts that space itself. Both give
the same bytes; offsets at which a token of A and a token of B end together
cut them into groups.

**Anchors.** Every text is tokenised whole by both. Where tokens of A and B
that begin with a space start at the same byte, the tokens before them end
together: such verified ends split a document into windows of ids, mostly a
word each. How a window aligns depends on its ids alone, so the windows of a
slice of texts are dictionary-encoded by their id tuples, each distinct one is
aligned once, and groups and links are dealt out by dictionary index. (A
dictionary kept over slices as Python objects was slower than aligning anew.)

**Links.** Two linked tokens end together, so the shorter one's bytes end the
longer one's. The pairs of vocabulary entries with that property are listed
from the vocabularies (:attr:`Aligner.pairs`; 324,297 of the two used here,
fewer than all tokens' bytes together). A link is a place in that list, which
bounds everything that is counted, collected or broadcast by the vocabularies
alone: the corpus-wide counts are one vector of that length.

Jobs: one scan tokenises, aligns and writes per document the digests and its
links, four bytes each; the links are counted per task and added up; a second
small job reads the written links beside the counts.

B is asked once for each distinct run of a slice: no piece of its vocabulary
has a space mark after another character or holds a line end, so merges never
cross the places where a space follows another character or a line ends
(checked when the vocabulary is loaded; otherwise it gets whole texts).

Defined results: null and empty texts, and texts whose bytes one tokenizer
does not give back (a literal U+2581 in B), have no tokens: zeros and an empty
digest. Repeated rows count each time. Null and repeated ids are kept. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.bpe import encode_texts
from wordloom.llm.common import Batches, in_arrow, written
from wordloom.llm.words import ragged, strings_at, texts_of, utf8_bytes

MARK = "▁"
SLICE_BYTES = 1 << 20      # texts are aligned this many bytes at a time, a longer one alone
SEPARATOR = np.uint32(0xFFFFFFFF)


def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary file. Printable bytes
    stand for themselves, the others for the characters from U+0100 on."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = spec["model"]["vocab"]
    special = {t["id"] for t in spec["added_tokens"]}
    out = [b""] * (1 + max([*vocab.values(), *special]))
    for entry, i in vocab.items():
        if i not in special:
            out[i] = bytes(byte_of[c] for c in entry)
    return out


def piece_bytes(processor) -> list[bytes]:
    """The bytes of each piece; control and unknown pieces have none."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif processor.is_control(i) or processor.is_unknown(i):
            out.append(b"")
        else:
            out.append(piece.replace(MARK, " ").encode())
    return out


def ending_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All ``(id of a, id of b)`` of which one's bytes end the other's, sorted,
    as ``a << 32 | b``."""
    places: tuple[dict, dict] = ({}, {})
    for place, entries in zip(places, (a, b)):
        for i, x in enumerate(entries):
            if x:
                place.setdefault(x, []).append(i)
    found = {(i << 32) | j for i, x in enumerate(a) for k in range(len(x)) for j in places[1].get(x[k:], ())}
    found |= {(i << 32) | j for j, x in enumerate(b) for k in range(len(x)) for i in places[0].get(x[k:], ())}
    return np.array(sorted(found), dtype=np.int64)


@dataclass
class Aligned:
    """Texts of a slice: tokens, groups and links of each, its digest, and the
    links of all texts in order."""
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    digest: list[str]
    n_links: np.ndarray
    links: np.ndarray


class Aligner:
    """One per Python worker and pair of vocabulary files; see :func:`aligner`."""

    def __init__(self, a_path: str, b_path: str, pairs: np.ndarray | None = None):
        import sentencepiece
        self.a_path = a_path
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a_bytes, b_bytes = byte_level_bytes(a_path), piece_bytes(self.b)
        self.spelling = tuple(np.frombuffer(b"".join(x), dtype=np.uint8) for x in (a_bytes, b_bytes))
        self.length = tuple(np.array([len(e) for e in x], dtype=np.int64) for x in (a_bytes, b_bytes))
        self.start = tuple(np.cumsum(n) - n for n in self.length)
        self.spaced = tuple(np.array([e.startswith(b" ") for e in x]) for x in (a_bytes, b_bytes))
        self.pairs = ending_pairs(a_bytes, b_bytes) if pairs is None else pairs
        entries = [e for i, e in enumerate(b_bytes) if not self.b.is_byte(i)]
        self.cuts = not any(b" " in e.lstrip(b" ") or b"\n" in e for e in entries)
        self.lone = self.b.piece_to_id(MARK)

    # ------------------------------------------------------------ tokenising

    def b_ids(self, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of B for texts that already have the space."""
        data, bounds = utf8_bytes(spaced)
        if not self.cuts:
            each = self.b.encode([t[1:] for t in spaced.to_pylist()], num_threads=1)
            return np.fromiter(chain.from_iterable(each), dtype=np.uint32), np.cumsum([0, *map(len, each)])
        space = data == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut |= data == 0x0A
        cut[bounds[:-1]] = True
        starts = np.flatnonzero(cut)
        coded = pc.dictionary_encode(strings_at(data, starts))
        runs, code = coded.dictionary, np.asarray(coded.indices)
        # the library puts a space before what it is given: for the run's own, or alone before a line end
        own = pc.starts_with(runs, " ")
        found = self.b.encode(pc.if_else(own, pc.utf8_slice_codeunits(runs, 1), runs).to_pylist(), num_threads=1)
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        pool = np.fromiter(chain(chain.from_iterable(found), [self.lone]), dtype=np.uint32, count=int(size.sum()) + 1)
        first = np.cumsum(size) - size
        extra = ~np.asarray(own.to_numpy(zero_copy_only=False))
        first, size = first + extra, size - extra
        empty = size == 0           # a run that is one space
        first[empty], size[empty] = len(pool) - 1, 1
        n = size[code]
        return pool[ragged(first[code], n)], np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, bounds)]

    # -------------------------------------------------------------- aligning

    def _kept(self, ids: list[np.ndarray], offsets: list[np.ndarray], spaced: pa.Array) -> np.ndarray:
        """Which texts both tokenizers give back byte for byte."""
        data, bounds = utf8_bytes(spaced)
        good = np.ones(len(spaced), dtype=bool)
        for side in (0, 1):
            n = self.length[side][ids[side]]
            total = np.concatenate([[0], np.cumsum(n)])[offsets[side]]
            good &= np.diff(total) == np.diff(bounds)
        for side in (0, 1):
            held = np.flatnonzero(good)
            mine = ids[side][ragged(offsets[side][held], np.diff(offsets[side])[held])]
            spelt = self.spelling[side][ragged(self.start[side][mine], self.length[side][mine])]
            size = np.diff(bounds)[held]
            wrong = np.flatnonzero(spelt != data[ragged(bounds[held], size)])
            good[held[np.searchsorted(np.cumsum(size), wrong, side="right")]] = False
        return good

    def windows_of(self, a: np.ndarray, size_a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For windows of ids, one after the other, ``size_a`` ids of A in
        each: groups as text, each ended by ``;``, the windows' bounds in it,
        their numbers of groups, and the links. Both sides of a window have the
        same bytes, so ends compare over all windows at once."""
        ends = [np.cumsum(self.length[0][a]), np.cumsum(self.length[1][b])]
        at_b = np.searchsorted(ends[1], ends[0])
        at_a = np.flatnonzero(ends[1][at_b] == ends[0])
        at_b = at_b[at_a]                       # the last tokens of each group
        links = np.searchsorted(self.pairs, (a[at_a].astype(np.int64) << 32) | b[at_b].astype(np.int64)).astype(np.int32)
        # the groups' tokens in order, those of A before those of B
        n_a, n_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        first = np.cumsum(n_a + n_b) - n_a - n_b
        place_a, place_b = ragged(first, n_a), ragged(first + n_a, n_b)
        ids = np.empty(len(a) + len(b), dtype=np.int64)
        ids[place_a], ids[place_b] = a, b
        after = np.full(len(ids), ord(","), dtype=np.uint8)
        after[place_a[at_a]], after[place_b[at_b]] = ord("|"), ord(";")
        digits = 1 + sum((ids >= 10 ** d).astype(np.int64) for d in range(1, 10))
        stop = np.cumsum(digits + 1)            # where the next token's text begins
        text = np.empty(int(stop[-1]) if len(stop) else 0, dtype=np.uint8)
        text[stop - 1] = after
        here = np.arange(len(ids))
        for d in range(1, 11):
            here = here[digits[here] >= d]
            text[stop[here] - 1 - d] = 48 + ids[here] // 10 ** (d - 1) % 10
        # windows end with a group
        last = np.searchsorted(at_a, np.cumsum(size_a) - 1)
        return text, np.concatenate([[0], stop[place_b[at_b[last]]]]), np.diff(last, prepend=-1), links

    def align(self, texts: pa.Array) -> Aligned:
        """``texts``: a large_string array without nulls or empty texts."""
        none = np.zeros(len(texts), dtype=np.int64)
        if not len(texts):
            return Aligned(none, none, none, [], none, np.zeros(0, np.int32))
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        ids_a, off_a = encode_texts(self.a_path, spaced)
        ids_b, off_b = self.b_ids(spaced)
        good = self._kept([ids_a, ids_b], [off_a, off_b], spaced)
        n_a, n_b = (np.where(good, np.diff(off), 0) for off in (off_a, off_b))
        a, b = ids_a[ragged(off_a[:-1], n_a)], ids_b[ragged(off_b[:-1], n_b)]
        if not len(a):
            return Aligned(n_a, n_b, none, [""] * len(texts), none, np.zeros(0, np.int32))

        # both sides have the same bytes, so offsets in the whole slice compare
        begin = [np.cumsum(self.length[s][x]) - self.length[s][x] for s, x in enumerate((a, b))]
        held = np.flatnonzero(n_a)
        first_a = (np.cumsum(n_a) - n_a)[held]
        # anchors: texts begin, or tokens of both sides begin with a space at one byte
        mark_a, mark_b = self.spaced[0][a], begin[1][self.spaced[1][b]]
        marked = np.flatnonzero(mark_a)
        at = np.minimum(np.searchsorted(mark_b, begin[0][marked]), max(len(mark_b) - 1, 0))
        mark_a[marked] = mark_b[at] == begin[0][marked] if len(mark_b) else False
        mark_a[first_a] = True
        cut_a = np.flatnonzero(mark_a)
        cut_b = np.searchsorted(begin[1], begin[0][cut_a])
        size_a, size_b = np.diff(np.append(cut_a, len(a))), np.diff(np.append(cut_b, len(b)))

        # a window's key: its ids of A, a separator, its ids of B
        size = size_a + size_b + 1
        start = np.cumsum(size) - size
        keys = np.full(int(size.sum()), SEPARATOR, dtype=np.uint32)
        keys[ragged(start, size_a)] = a
        keys[ragged(start + size_a + 1, size_b)] = b
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [
            None, pa.py_buffer(np.append(start, len(keys)) * 4), pa.py_buffer(keys)])
        coded = pc.dictionary_encode(packed)
        code = np.asarray(coded.indices)
        one = np.empty(len(coded.dictionary), dtype=np.int64)
        one[code] = np.arange(len(code))        # a window with each id tuple
        text, cut, n_found, pool = self.windows_of(a[ragged(cut_a[one], size_a[one])], size_a[one],
                                                   b[ragged(cut_b[one], size_b[one])])
        links = pool[ragged((np.cumsum(n_found) - n_found)[code], n_found[code])]

        # windows of each text: from its first anchor to the next text's
        at = np.full(len(texts) + 1, len(code))
        at[held] = np.searchsorted(cut_a, first_a)
        at = np.minimum.accumulate(at[::-1])[::-1]
        size = np.diff(cut)[code]
        groups = text[ragged(cut[:-1][code], size)].tobytes()
        total, ends = (np.concatenate([[0], np.cumsum(x)]) for x in (n_found[code], size))
        n_groups = total[at[1:]] - total[at[:-1]]
        digest = [hashlib.sha256(groups[x:y - 1]).hexdigest() if y > x else ""
                  for x, y in zip(ends[at[:-1]].tolist(), ends[at[1:]].tolist())]
        # ends are shared by one token of each side: a group has one link
        return Aligned(n_a, n_b, n_groups, digest, n_groups, links)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str, pairs: np.ndarray | None = None) -> Aligner:
    key = (a_path, b_path)
    if key not in _aligners:
        _aligners[key] = Aligner(a_path, b_path, pairs)
    return _aligners[key]


ALIGNED = "doc_id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<int>"


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links)``; a link
    is a place in :attr:`Aligner.pairs`, which workers get from the driver."""
    pairs = docs.sparkSession.sparkContext.broadcast(aligner(a_path, b_path).pairs)

    def run(batches: Batches) -> Batches:
        held = aligner(a_path, b_path, pairs.value)
        for batch in batches:
            texts = texts_of(batch.column(1))
            bounds = utf8_bytes(texts)[1]
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, side="right")) - 1)
                yield _rows(held, batch.column(0).slice(at, end - at), texts.slice(at, end - at))
                at = end

    kind = docs.schema[id_col].dataType.simpleString()
    return in_arrow(docs.select(F.col(id_col), F.col(text_col)), run, ALIGNED.format(id=kind))


def _rows(held: Aligner, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    full = np.asarray(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    got = held.align(texts.filter(pa.array(full)))
    place = np.flatnonzero(full)

    def spread(x):
        out = np.zeros(len(full), dtype=np.int64)
        out[place] = x
        return out
    n_links = spread(got.n_links)
    digest = np.full(len(full), "", dtype=object)
    digest[place] = got.digest
    links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)), pa.array(got.links))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(spread(got.n_a)), pa.array(spread(got.n_b)), pa.array(spread(got.n_groups)), pa.array(n_links),
         pa.array(digest, pa.string()), links], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


def pair_counts(aligned: DataFrame, n_pairs: int) -> DataFrame:
    """``(pair, n)``: links of each pair over the corpus; a task sends a row
    for each pair it has seen, at most ``n_pairs``."""
    def run(batches: Batches) -> Batches:
        total = np.zeros(n_pairs, dtype=np.int64)
        for b in batches:
            links = np.asarray(b.column(0).flatten())
            if len(links):
                total += np.bincount(links, minlength=n_pairs)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "n"])
    return in_arrow(aligned.select("links"), run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment_table(counts: DataFrame, pairs: np.ndarray) -> DataFrame:
    """``(a, b, n, best)``: how often ids are linked, and whether no other id
    of A is linked more often to that id of B."""
    spark = counts.sparkSession
    names = spark.createDataFrame([(i, int(p >> 32), int(p & 0xFFFFFFFF)) for i, p in enumerate(pairs.tolist())],
                                  "pair bigint, a int, b int")
    known = counts.join(names, "pair")
    best = known.groupBy("b").agg(F.max("n").alias("most"))
    return known.join(best, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def digests(aligned: DataFrame, counts: DataFrame, pairs: np.ndarray) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` instead of ``links``.
    Counts come as one number a pair of the vocabularies (2.6 MB here)."""
    total = np.zeros(len(pairs), dtype=np.int64)
    got = counts.toArrow()      # at most len(pairs) rows
    total[np.asarray(got.column("pair"))] = np.asarray(got.column("n"))
    b = (pairs & 0xFFFFFFFF).astype(np.int64)
    most = np.zeros(int(b.max()) + 1 if len(b) else 1, dtype=np.int64)
    np.maximum.at(most, b, total)
    held = aligned.sparkSession.sparkContext.broadcast((total, total == most[b]))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Batches) -> Batches:
        count, best = held.value
        for batch in batches:
            col = batch.column(len(kept))
            links, off = np.asarray(col.flatten()), np.asarray(col.offsets)
            off = off - off[0]
            sums = [np.concatenate([[0], np.cumsum(x[links], dtype=np.int64)]) for x in (best, count)]
            n_best, count_sum = (s[off[1:]] - s[off[:-1]] for s in sums)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(n_best), pa.array(count_sum)],
                                             [*kept, "n_best", "count_sum"])

    types = {f.name: f.dataType.simpleString() for f in aligned.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", n_best bigint, count_sum bigint"
    return in_arrow(aligned.select(*kept, "links"), run, schema)


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, n_best, count_sum``."""
    spark = docs.sparkSession
    pairs = aligner(a_path, b_path).pairs
    rows = written(spark, align(docs, a_path, b_path, id_col, text_col), "aligned")
    counts = written(spark, pair_counts(rows, len(pairs)), "pair-counts")
    return digests(rows, counts, pairs)
