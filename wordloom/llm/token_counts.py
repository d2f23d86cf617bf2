"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates, for every position of a text, the
vocabulary pieces that end there, longest first. The dynamic program keeps
two numbers per position, the best score of a segmentation ending there and
the number of its pieces; no path is stored.

Tie rules are those of the public unigram tokenizers: a later candidate wins
only with a strictly better score, and candidates come longest piece first. A
character with no piece of its own may be taken as unknown at ten below the
lowest score; unknown characters become their UTF-8 bytes where the
vocabulary has all 256 byte pieces, else a stretch of them is one piece.

Spaces are written as U+2581, one is put before a text, and an empty text has
no tokens. Where no piece holds that mark after another character, every best
segmentation breaks before each group of spaces (a mark in the text itself is
one, and is read as a space); where also all scores are
whole numbers, sums carry no rounding and the break changes no tie. Then each
distinct stretch of a batch is counted once. Otherwise whole texts are run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wordloom.llm.common import map_batches
from wordloom.llm.words import row_sums, strings_at, texts_of, utf8_bytes

MARK = "▁"
CACHE_ENTRIES = 500_000
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; ``has_bytes`` if all byte pieces are there;
    ``lowest`` is the least score of the file, byte pieces included."""
    scores: dict[str, float]
    has_bytes: bool
    lowest: float


def load_vocabulary(model_file: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece file, read as a unigram
    vocabulary. Control and unknown symbols are never matched in text."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(sp.get_piece_size())
    n_bytes = sum(sp.is_byte(i) for i in ids)
    scores = {sp.id_to_piece(i): float(sp.get_score(i)) for i in ids
              if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    lowest = min((float(sp.get_score(i)) for i in ids), default=0.0)
    return Vocabulary(scores, n_bytes == 256, lowest)


class Counter:
    """Counts the pieces of strings under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p in vocabulary.scores if len(p) == 1}
        self.unknown = vocabulary.lowest - UNKNOWN_PENALTY
        self.has_bytes = vocabulary.has_bytes
        self.by_stretch = (all(MARK not in p.lstrip(MARK) for p in vocabulary.scores)
                           and all(s == int(s) for s in vocabulary.scores.values())
                           and self.unknown == int(self.unknown))
        self.cache: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Pieces of the best segmentation of ``text`` (marks already put)."""
        n = len(text)
        ends: list[list | None] = [None] * (n + 1)
        for end, match in self.automaton.iter(text):
            if ends[end + 1] is None:
                ends[end + 1] = [match]
            else:
                ends[end + 1].append(match)
        best = [0.0] * (n + 1)
        pieces = [0] * (n + 1)
        unknown = [False] * (n + 1)
        for e in range(1, n + 1):
            top, top_pieces, top_unknown = None, 0, False
            for length, score in ends[e] or ():
                s = e - length
                candidate = best[s] + score
                if top is None or candidate > top:
                    top, top_pieces = candidate, pieces[s] + 1
            c = text[e - 1]
            if c not in self.singles:
                candidate = best[e - 1] + self.unknown
                if top is None or candidate > top:
                    top, top_unknown = candidate, True
                    if self.has_bytes:
                        top_pieces = pieces[e - 1] + len(c.encode())
                    else:
                        top_pieces = pieces[e - 1] + (not unknown[e - 1])
            best[e], pieces[e], unknown[e] = top, top_pieces, top_unknown
        return pieces[n]

    def stretch(self, s: str) -> int:
        n = self.cache.get(s)
        if n is None:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            n = self.cache[s] = self.count(s.replace(" ", MARK))
        return n

    def texts(self, texts: pa.Array) -> np.ndarray:
        if not self.by_stretch:
            return np.array([self.count((" " + t).replace(" ", MARK)) if t else 0
                             for t in texts.to_pylist()], dtype=np.int64)
        # a mark in the text is a space to every piece, so cuts must treat it as one
        data, bounds = utf8_bytes(pc.replace_substring(texts, MARK, " "))
        if not len(data):
            return np.zeros(len(texts), dtype=np.int64)
        space = data == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        begins = bounds[:-1][np.diff(bounds) > 0]
        cut[begins] = True
        starts = np.flatnonzero(cut)
        coded = strings_at(data, starts).dictionary_encode()
        strings, code = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        first = np.searchsorted(starts, begins)
        later = np.ones(len(starts), dtype=bool)
        later[first] = False
        counts = np.zeros(len(strings), dtype=np.int64)
        for i in np.unique(code[later]):
            counts[i] = self.stretch(strings[i])
        per_run = counts[code]
        per_run[first] = [self.stretch(" " + strings[i]) for i in code[first]]
        return row_sums(per_run, np.searchsorted(starts, bounds))


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens)`` for every row; null and empty texts have 0 tokens.

    No shuffle. Repeated rows come out as often as they came in; null ids
    stay null. The vocabulary file must be readable on every executor.
    """
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if model_file not in _counters:
            _counters[model_file] = Counter(load_vocabulary(model_file))
        n = _counters[model_file].texts(texts_of(b.column(1)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(id_col, text_col), run, f"id {kind}, n_tokens bigint")
    return out.withColumnRenamed("id", id_col)
