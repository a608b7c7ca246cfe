"""Words of many texts at once: boundaries, hashes and hashes of word windows, in numpy.

A word is a run of bytes other than blank and the ASCII controls 9 to 13. Hashes are
the same in every process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEED = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + np.uint64(salt * _SEED & 0xFFFFFFFFFFFFFFFF))


_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(1) << np.uint64(20))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_places = np.zeros(0, np.uint64)


def _multipliers(n: int) -> np.ndarray:
    global _places
    if len(_places) < n:
        _places = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(_SEED)) | np.uint64(1)
    return _places[:n]


@dataclass
class Words:
    """Words of a chunk of texts. ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # where texts start in ``data``
    starts: np.ndarray  # where words start
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; a null text has none. ``lower`` takes A-Z as a-z."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    lengths = ends - starts
    if len(starts):
        chars = data[inside]
        heads = np.cumsum(lengths) - lengths
        places = np.arange(len(chars)) - np.repeat(heads, lengths)
        terms = (_LOWER if lower else _BYTES)[chars] * _multipliers(int(lengths.max()))[places]
        hashes = mix(np.add.reduceat(terms, heads) + lengths.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(data, offsets, starts, ends, first, hashes)


def window_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of every ``k`` values in a row (across texts too; the caller picks the valid ones)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    left, right = np.uint64(2 * salt * 0xD6E8FEB86659FD93 + 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF), np.uint64(0xE7037ED1A0B428DB)
    power, size, out, length = h, 1, None, 0
    while k:
        if k & 1:
            if out is None:
                out, length = power, size
            else:
                n = min(len(out), len(power) - length)
                out, length = mix(out[:n] * left ^ power[length:length + n] * right), length + size
        k >>= 1
        if k:
            n = len(power) - size
            power, size = mix(power[:n] * left + power[size:] * right), size * 2
    return out


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of every ``k`` values in a row."""
    if len(x) < k:
        return x[:0]
    out, size = x, 1
    while size * 2 <= k:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    if size < k:
        out = np.minimum(out[: len(x) - k + 1], out[k - size:])
    return out


def joined_words(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of each text joined by one blank, and where each text starts and ends.

    Text ``i`` is ``out[begin[i]:end[i]]``.
    """
    lengths = (words.ends - words.starts)[keep] + 1
    place = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(place[-1], 32, np.uint8)
    sizes = lengths - 1
    source = np.repeat(words.starts[keep] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    target = np.repeat(place[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    out[target] = words.data[source]
    kept_before = np.concatenate([[0], np.cumsum(keep)])[words.first]
    begin, end = place[kept_before[:-1]], place[kept_before[1:]]
    return out, np.stack([begin, np.maximum(begin, end - 1)])
