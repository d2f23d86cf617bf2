"""Splitting whole columns of text into words with Arrow kernels.

A batch of texts becomes one dictionary of distinct words plus an index per
word, so that costly work (tokenizer calls, hash lookups) runs once per
distinct word of a batch and the rest is numpy on the indices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """``index[offsets[i]:offsets[i + 1]]`` are the words of text ``i`` as
    positions in ``distinct``."""
    distinct: list[str]
    index: np.ndarray
    offsets: np.ndarray


def texts_of(col: pa.Array) -> pa.Array:
    """The column with nulls as empty texts."""
    return pc.fill_null(col.cast(pa.large_string()), "")


def _indexed(lists: pa.Array) -> Words:
    flat = lists.flatten()
    enc = pc.dictionary_encode(flat)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    return Words(enc.dictionary.to_pylist(), np.asarray(enc.indices), offsets - offsets[0])


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_string column without nulls, and the byte at which
    each text begins (one more entry marks the end)."""
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or bounds[-1] == bounds[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds - bounds[0]


def strings_at(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes cut at ``starts``, as strings that share their memory."""
    ends = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    return pa.LargeStringArray.from_buffers(len(starts), ends, pa.py_buffer(data))


def split_words(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    w = _indexed(pc.ascii_split_whitespace(texts))
    if "" in w.distinct:
        keep = w.index != w.distinct.index("")
        before = np.concatenate([[0], np.cumsum(keep)])
        w = Words(w.distinct, w.index[keep], before[w.offsets])
    return w


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1``, concatenated."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = starts - (ends - lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(shift, lengths)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
