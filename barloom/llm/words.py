"""Words, word hashes and shingle hashes of whole Arrow batches, as numpy arrays.

Texts are handled as UTF-8 bytes.  All separators are ASCII, so cutting at bytes equals cutting at
characters.  Nothing here looks at more than one batch; tables are made by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: words are ``[^\x20\x09-\x0D]+``
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 1 << 18
#: bytes of text that are worked on at once; a worker's arrays take some thirty times as much
RUN = 1 << 20
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finaliser of multiplications and shifts)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        back = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        size = max(1 << (n - 1).bit_length(), _BLOCK)
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _PRIME)]))
        _inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, back)]))
    return _powers, _inverses


def texts(column: pa.Array, most: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The rows of a string column in runs of about ``most`` bytes: first row, end row, bytes and
    offsets (null: no bytes).  A longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def cut(data: np.ndarray, at: np.ndarray, separators: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each text (and of the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    cuts = np.searchsorted(starts, np.arange(0, int(starts[-1]) + _BLOCK, _BLOCK))
    for i, j in zip(cuts[:-1], cuts[1:]):
        if i == j:
            continue
        low, high = int(starts[i]), int(ends[j - 1])
        powers, inverses = _tables(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64) * _STEP)
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside a text, the text of each, and the word it starts at.
    ``first`` is the third result of :func:`cut`."""
    n = len(hashes) - k + 1
    counts = np.diff(first)
    if n <= 0 or not (counts >= k).any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc = acc * _STEP + hashes[j : j + n]
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = doc[:n] == doc[k - 1 : k - 1 + n]
    start = np.flatnonzero(whole)
    return mix(acc[start]), doc[start], start
