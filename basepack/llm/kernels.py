"""Vectorised kernels on sequences of symbols (bytes or word identifiers).

Every function works on one block of concatenated documents.  ``bounds`` holds the
offsets of the documents in the block (length: documents + 1).
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_POS_BITS = 26
_POS_MASK = _U((1 << _POS_BITS) - 1)
#: Most symbols of one block: positions share a 64-bit key with 38 bits of hash.
MAX_BLOCK = 1 << _POS_BITS


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; works on a copy."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0x9FB21C651E98DF25)
    h ^= h >> _U(32)
    return h


def _factor(span: int) -> np.uint64:
    return _U(pow(0x9E3779B97F4A7C15, span, 1 << 64))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k``-grams of 64-bit symbol hashes, by doubling; length n - k + 1."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    out, done, power, span = None, 0, symbols, 1
    while True:
        if k & span:
            piece = power[done : done + n]
            out = piece.copy() if out is None else out * _factor(span) + piece
            done += span
        if done == k:
            return mix(out)
        power = power[:-span] * _factor(span) + power[span:]
        span *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def anchored_runs(grams: np.ndarray, bounds: np.ndarray, window: int, k: int):
    """Runs of windows of ``window`` symbols that have the same minimal ``k``-gram.

    Returns (first window start, last window start, position of the k-gram), each window
    within a document.  Equal windows choose the k-gram at the same offset, so a window's
    anchor hash depends on its content only.
    """
    if len(grams) > MAX_BLOCK:
        raise ValueError(f"a block has at most {MAX_BLOCK} k-grams")
    empty = np.empty(0, np.int64)
    w = window - k + 1
    if len(grams) < w:
        return empty, empty, empty
    key = (grams & ~_POS_MASK) | np.arange(len(grams), dtype=_U)
    at = (sliding_min(key, w) & _POS_MASK).astype(np.int64)
    del key
    ok = np.zeros(len(at) + 1, np.int32)
    first, last = bounds[:-1], bounds[1:] - window
    has = last >= first
    np.add.at(ok, first[has], 1)
    np.add.at(ok, last[has] + 1, -1)
    ok = np.cumsum(ok[:-1]) > 0
    new = ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    starts = np.flatnonzero(new)
    # A run may not pass the end of a document: the window behind it is not valid, or new.
    new_or_off = np.flatnonzero(new | ~ok)
    nxt = np.searchsorted(new_or_off, starts, side="right")
    ends = np.where(nxt < len(new_or_off), new_or_off[np.minimum(nxt, len(new_or_off) - 1)], len(at)) - 1
    doc = np.searchsorted(bounds, starts, side="right")
    return starts, np.minimum(ends, bounds[doc] - window), at[starts]


def runs_of(mask: np.ndarray):
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the positions that any of the intervals [start, end) covers."""
    d = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the intervals, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    step = np.ones(total, np.int64)
    lengths = np.asarray(lengths, np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts, np.int64)[keep], lengths[keep]
    heads = np.cumsum(lengths) - lengths
    step[heads[0]] = starts[0]
    step[heads[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of integer keys.  Equal keys have equal ranks, so the sort need not be stable, and is several times faster."""
    order = np.argsort(keys)
    s = keys[order]
    step = np.zeros(len(s), np.int32)
    step[1:] = s[1:] != s[:-1]
    del s
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(step, dtype=np.int32)
    return out


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of keys from 0 to 2^31 - 1, fewer than 2^32 of them: place and key sort as one number."""
    both = (keys.astype(np.int64) << 32) | np.arange(len(keys))
    both.sort()
    return both & 0xFFFFFFFF
