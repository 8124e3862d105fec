"""Sets of word shingles of whole texts, as 64-bit hashes, for a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POWERS = np.multiply.accumulate(np.full(1 << 16, _A, np.uint64))
_S32, _S29 = np.uint64(32), np.uint64(29)
#: bytes hashed at a time; a longer text is a part of its own
PART = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _B
    x ^= x >> _S29
    x *= _C
    x ^= x >> _S32
    return x


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in `data`, text i from bounds[i] to bounds[i + 1]; words before each bound."""
    low = _LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = ~_BLANK[low]
    cut = np.zeros(len(low) + 1, bool)  # a text's border ends a word
    cut[bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    before = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    lengths = ends - starts
    chosen = low[inside[1:-1]]
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(chosen)) - np.repeat(first, lengths)
    terms = (chosen.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 0xFFFF]
    if lengths.max() > 1 << 16:
        terms *= (place >> 16).astype(np.uint64) * _C + np.uint64(1)
    return mixed(np.add.reduceat(terms, first) ^ (lengths.astype(np.uint64) * _C)), before


def text_parts(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, bounds, first row) of runs of texts of at most PART bytes, or of one longer text; NULL is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + PART, "right")) - 1)
        out.append((data[at[i]:at[j]], at[i:j + 1] - at[i], i))
        i = j
    return out


def shingle_sets(texts: pa.Array, n: int):
    """Yields (first row, values, sizes): sorted distinct hashes of runs of n words, texts end to end.

    A text of fewer than n words has one shingle, the whole sequence; without words it has none.
    """
    for data, bounds, row in text_parts(texts):
        words, before = word_hashes(data, bounds)
        rolled = _rolled(words, n)
        sets = []
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= n:
                s = np.sort(rolled[a:b - n + 1])
                sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                sets.append(_rolled(words[a:b], b - a) ^ np.uint64(b - a))
            else:
                sets.append(words[:0])
        yield row, np.concatenate(sets) if sets else words[:0], np.array([len(s) for s in sets])


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = (out ^ words[j:j + m]) * _A + _B
    return mixed(out)
