"""Repeated strings of a block of bytes from its Burrows-Wheeler transform.

Only blocks of bounded size come here; which pieces meet in a block is decided on Spark (``bwt_dedup``).
"""

from __future__ import annotations

import numpy as np


def _ranked(key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order of the keys; their ranks (equal keys: equal ranks, from 1 on) are put into ``rank``."""
    order = np.argsort(key)
    ordered = key[order]
    rank[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
    return order


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least (prefix doubling)."""
    n = len(symbols)
    # as many symbols as fit in one number are compared at once to begin with
    bits = max(1, int(symbols.max() + 1).bit_length())
    h = max(1, min(62 // bits, depth))
    key = np.zeros(n + h, np.int64)
    for j in range(h):
        key[: max(0, n - j)] |= (symbols[j:] + 1) << (bits * (h - 1 - j))
    key = key[:n]
    rank = np.zeros(n, np.int64)
    order = _ranked(key, rank)
    while True:
        if h >= depth or rank[order[-1]] == n:
            return order
        key = rank * (n + 1)
        key[: max(0, n - h)] += rank[h:]
        order, h = _ranked(key, rank), 2 * h


def repeated(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece the starts of the strings of ``length`` bytes that start elsewhere in the block, too.

    The pieces are joined with separators that differ from each other, so no common prefix crosses one.  From the
    transform, intervals of suffixes with a common prefix are expanded to the left, one symbol per level; an expansion
    that ends where no common prefix is known yet fixes it at that level.  The levels are the common prefixes
    in increasing order; after level ``length`` those that are not fixed are as long or longer.
    """
    if not pieces:
        return []
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1)
    n = int(ends[-1])
    symbols = np.empty(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends - 1] = False
    symbols[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + len(pieces)
    symbols[~inside] = np.arange(len(pieces))
    order = suffix_order(symbols, length + 1)
    last = symbols[order - 1]
    # where the suffix with one more symbol to the left stands
    to = np.empty(n, np.int64)
    to[np.argsort(last, kind="stable")] = np.arange(n)

    known = np.zeros(n + 1, bool)
    known[n] = known[0] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        if not len(low):
            break
        count = high - low
        offset = np.cumsum(count) - count
        own = np.repeat(np.arange(len(low)), count)
        at = np.arange(len(own)) - offset[own] + low[own]
        target = to[at]
        if len(own) > len(low):
            # expansions by one symbol are runs of targets in order
            group = own * (len(pieces) + 256) + last[at]
            if (int(group.max()) + 1) * n < 1 << 63:
                key = np.sort(group * n + target)
                group, target = key // n, key % n
            else:
                ranked = np.argsort(group, kind="stable")
                group, target = group[ranked], target[ranked]
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            left, right = target[begin], target[np.concatenate([begin[1:], [len(group)]]) - 1] + 1
        else:
            left, right = target, target + 1
        new = ~known[right]
        left, right = left[new], right[new]
        # several expansions can end at one place only if they are the same
        known[right] = True
        low, high = left, right
    open_ = ~known[:n]
    twice = open_.copy()
    twice[:-1] |= open_[1:]
    starts = np.sort(order[twice])
    bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
    first = ends - sizes - 1
    return [starts[a:b] - f for a, b, f in zip(bounds[:-1], bounds[1:], first)]
