"""Whole texts of an Arrow batch as flat byte arrays, and hashes of words and byte strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SLICE = 1 << 20


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the offsets of the texts; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    whole = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    if data is None or not len(whole) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(whole) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes together; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, _SLICE + 65536)
        _POWERS["up"] = np.cumprod(np.full(size, U(_BASE)))
        _POWERS["down"] = np.cumprod(np.full(size, U(pow(_BASE, -1, 1 << 64))))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any substring follows (see ``between``)."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE_VALUES[data] * _powers(len(data))[0], out=sums[1:])
    return sums


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [starts, ends), not yet mixed; equal strings hash alike."""
    return (sums[ends] - sums[starts]) * _powers(len(sums))[1][starts]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# Everything in ASCII but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the offsets of the texts in them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = gaps[data]
    inside = offsets[(offsets > 0) & (offsets < len(data))]
    begin = np.empty(len(data), bool)
    begin[0] = True
    begin[1:] = gap[:-1]
    begin[inside] = True
    stop = np.empty(len(data), bool)
    stop[-1] = True
    stop[:-1] = gap[1:]
    stop[inside - 1] = True
    starts = np.flatnonzero(begin & ~gap)
    return starts, np.flatnonzero(stop & ~gap) + 1, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text in order, A-Z lower-cased, and the offsets of the
    texts in them. Words are runs of bytes other than space, \\t, \\n, \\v, \\f and \\r."""
    starts, ends, to = word_spans(data, offsets, SPACES)
    return mix(between(prefix_hashes(lower(data)), starts, ends)), to


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; with fewer words, of all together."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, U(size))
    for i in range(size):
        total = mix(total + words[i : i + n])
    return total


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text in order."""
    data, offsets = flat(texts)
    for first, last in slices(offsets):
        at = offsets[first : last + 1]
        words, to = word_hashes(data[at[0] : at[-1]], at - at[0])
        for i in range(last - first):
            yield np.unique(shingle_hashes(words[to[i] : to[i + 1]], size))


def binaries(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())
