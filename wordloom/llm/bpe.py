"""Exact ids of the ``tokenizers`` library, one call per distinct word.

Both public vocabularies used here cut a text into pre-tokens with a regular
expression before any merge. :func:`encode_texts` makes cuts only where that
expression always makes them, dictionary-encodes the runs between the cuts
with Arrow, asks the library once per distinct run and deals the ids out
again with numpy. The cuts, for a whole batch of UTF-8 bytes at once:

* where a letter (ASCII or Latin-1) meets anything else, unless the stretch
  between white space holds an apostrophe (it may start a contraction) or a
  character beyond Latin-1 letters and ASCII: such a stretch stays uncut;
* around white space. The byte-level scheme gives a run of k white space
  characters before other text as k - 1 characters, then the last one, which
  joins what follows if it is a space; a run at the end stays whole. The
  other scheme drops white space.

A text with white space beyond ASCII goes to the library uncut in the
byte-level scheme, whose runs it would join.

Ids of runs stay in two bounded dictionaries per Python worker, the older one
being dropped when the newer is full, so memory does not grow with the input.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wordloom.llm.words import ragged, strings_at, utf8_bytes

CACHE_ENTRIES = 100_000   # per generation; two generations are held
SLICE_BYTES = 4 << 20     # texts are cut and dealt out this many bytes at a time
RUNS_PER_CALL = 200
WIDE_SPACE = re.compile("[" + "".join(map(chr, (
    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")

_byte = np.arange(256)
_LETTER = ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122))
_SPACE = (_byte == 32) | ((_byte >= 9) & (_byte <= 13))


class Encoder:
    """One per Python worker and tokenizer file; see :func:`encoder`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # a pre-token of the byte-level scheme may start with a space; the
        # scheme that splits first drops white space
        self.keeps_space = "Split" not in str(self.tokenizer.pre_tokenizer)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def each(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch(strings, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of letter runs, many to a call, dealt out by word number."""
        out: list[bytes] = []
        groups = [words[i:i + RUNS_PER_CALL] for i in range(0, len(words), RUNS_PER_CALL)]
        texts = [("" if self.keeps_space else " ").join(g) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            word = np.array(e.word_ids, dtype=np.int64)
            cut = [0, *(4 * (np.flatnonzero(np.diff(word)) + 1)).tolist(), 4 * len(word)]
            ids = np.array(e.ids, dtype="<u4").tobytes()
            if len(cut) == len(g) + 1:
                out += [ids[a:b] for a, b in zip(cut, cut[1:])]
            else:
                out += self.each(g)
        return out

    def runs(self, strings: list[str]) -> list[bytes]:
        """Ids of each run, from the dictionaries or the library."""
        new, old = self.new, self.old
        got = [new.get(s) or old.get(s) for s in strings]
        missing = [i for i, b in enumerate(got) if b is None]
        if missing:
            lead = 1 if self.keeps_space else 0
            word, other = [], []
            for i in missing:
                s = strings[i]
                (word if s[lead:].isalpha() and (not lead or s[0] == " ") else other).append(i)
            fresh = {}
            for at, ids in ((word, self._joined([strings[i] for i in word])),
                            (other, self.each([strings[i] for i in other]))):
                for i, b in zip(at, ids):
                    got[i] = b
                    fresh[strings[i]] = b
            if len(new) + len(fresh) > CACHE_ENTRIES:
                self.old, self.new = new, {}
            for s, b in fresh.items():
                if len(self.new) >= CACHE_ENTRIES:
                    break
                self.new[s] = b
        return got


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _cuts(b: np.ndarray, starts: np.ndarray, keeps_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes at which a run begins, and which bytes are white space."""
    n = len(b)
    letter, space = _LETTER[b], _SPACE[b]
    high = b >= 0x80
    latin = np.zeros(n, dtype=bool)
    lead = np.flatnonzero(b[:-1] == 0xC3)
    lead = lead[(b[lead + 1] != 0x97) & (b[lead + 1] != 0xB7)]
    latin[lead] = latin[lead + 1] = True
    letter |= latin
    unsafe = (high & ~latin) | (b == 0x27)
    at_start = np.zeros(n, dtype=bool)
    at_start[starts[starts < n]] = True
    edge = np.empty(n, dtype=bool)      # white space meets other text, or a text begins
    edge[0] = True
    edge[1:] = space[1:] != space[:-1]
    edge |= at_start
    cut = np.empty(n, dtype=bool)
    cut[0] = True
    cut[1:] = letter[1:] != letter[:-1]
    if unsafe.any():
        stretch = np.cumsum(edge) - 1
        bad = np.zeros(stretch[-1] + 1, dtype=bool)
        bad[stretch[unsafe]] = True
        cut &= ~bad[stretch]
    cut |= edge
    if keeps_space:
        # the last character of a white space run stands apart from those
        # before it, unless the text ends there; a space joins what follows
        ends_text = np.zeros(n, dtype=bool)
        ends_text[starts[(starts > 0) & (starts <= n)] - 1] = True
        ends_text[n - 1] = True
        last = space & ~ends_text
        last[:-1] &= ~space[1:]
        cut |= last
        joins = np.flatnonzero(last & (b == 0x20))
        cut[joins + 1] = False
    return cut, space


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, offsets)``: the ids of all texts in order, and where each
    text's ids begin. Equal to encoding each whole text with the library.
    ``texts``: a large_string array without nulls. Whole texts are taken up
    to :data:`SLICE_BYTES` at a time (a longer one alone), which bounds the
    arrays in between."""
    enc = encoder(path)
    bounds = utf8_bytes(texts)[1]
    ids, sizes, at = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, side="right")) - 1)
        part, offsets = _encode_slice(enc, texts.slice(at, end - at))
        ids.append(part)
        sizes.append(np.diff(offsets))
        at = end
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _encode_slice(enc: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    b, bounds = utf8_bytes(texts)
    if not len(b):
        return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
    cut, space = _cuts(b, bounds, enc.keeps_space)
    starts = np.flatnonzero(cut)
    run = strings_at(b, starts)
    if not enc.keeps_space:
        keep = ~space[starts]
        starts = starts[keep]
        run = run.filter(pa.array(keep))
    coded = pc.dictionary_encode(run)
    ids = enc.runs(coded.dictionary.to_pylist())
    length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    pool = np.frombuffer(b"".join(ids), dtype="<u4")
    code = np.asarray(coded.indices)
    n_ids = length[code]
    out = pool[ragged((np.cumsum(length) - length)[code], n_ids)]
    offsets = np.concatenate([[0], np.cumsum(n_ids)])[np.searchsorted(starts, bounds)]
    if enc.keeps_space and (b >= 0x80).any():
        odd = [i for i, t in enumerate(texts.to_pylist()) if not t.isascii() and WIDE_SPACE.search(t)]
        if odd:
            redo = dict(zip(odd, enc.each([texts[i].as_py() for i in odd])))
            parts = [np.frombuffer(redo[i], dtype="<u4") if i in redo else out[offsets[i]:offsets[i + 1]]
                     for i in range(len(texts))]
            out = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return out, offsets
