"""Words, 64-bit word hashes and shingles of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

from . import caches
from . import kernels as K

#: A word is a run of bytes that are none of these; the same set as ``bytes.split()`` uses.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


class _Hashes(dict):
    """Hashes of words seen; an accelerator only."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = caches.register("words", _Hashes())
_MOST = caches.entries()


def split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts, and the offsets of each text's words (length: texts + 1)."""
    caches.use("words")
    parts = [t.split() for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return [w for p in parts for w in p], bounds


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    caches.bound(_hashes, _MOST)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


_BLANKS = bytes.maketrans(SPACES, b" " * len(SPACES))
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a word up to which it is hashed with all others, 8 bytes at a time.
_LONG = 64


def places(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts, each with one blank behind it, as one string; each word's start and end there; and the offsets of each text's words.

    No object is made for a word; the words are those of ``split``.
    """
    caches.use("places")
    raw = np.frombuffer(b" ".join(texts).translate(_BLANKS), np.uint8)
    behind = np.ones(len(raw) + 1, bool)  # whether a blank, or nothing, stands before each place
    behind[1:] = raw == 32
    blank = np.append(behind[1:], True)
    starts = np.flatnonzero(behind & ~blank)
    sizes = np.flatnonzero(blank & ~behind) - starts
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    hi = np.cumsum(sizes + 1) - 1
    return raw[~(behind & blank)[:-1]].tobytes(), hi - sizes, hi, np.searchsorted(starts, at)


def place_hashes(data: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hash of each word ``data[lo:hi]``; not those of ``hashes``."""
    if not len(lo):
        return np.empty(0, np.uint64)
    first = int(lo[0])
    part = data[first : int(hi[-1])] + bytes(8)
    eight = np.ndarray(len(part) - 7, "<u8", part, strides=(1,))
    lo, size = lo - first, hi - lo
    out = K.mix((eight[lo] & _LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at, done = np.flatnonzero(size > 8), 8
    while len(at):
        if done == _LONG:
            out[at] = [xxhash.xxh3_64_intdigest(part[i : i + n]) for i, n in zip(lo[at].tolist(), size[at].tolist())]
            break
        rest = size[at] - done
        out[at] = K.mix(out[at] * np.uint64(0x9E3779B97F4A7C15) + (eight[lo[at] + done] & _LOW[np.minimum(rest, 8)]))
        at, done = at[rest > 8], done + 8
    return out


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed ``n``-word shingles of each text, sorted; and their offsets.

    A text of fewer words has its whole word sequence as one shingle, a text without words none.
    A-Z count as a-z.
    """
    words, bounds = split([t.lower() for t in texts])
    h = hashes(words)
    sizes = np.diff(bounds)
    grams = K.gram_hashes(h, n)
    counts = np.maximum(sizes - n + 1, 0)
    long = K.spread(bounds[:-1], counts)
    doc = np.repeat(np.arange(len(texts)), counts)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    extra = np.array([xxhash.xxh3_64_intdigest(h[bounds[i] : bounds[i + 1]].tobytes(), seed=n) for i in short], np.uint64)
    values, doc = np.concatenate([grams[long], extra]), np.concatenate([doc, short])
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(doc, minlength=len(texts)), out=edges[1:])
    if len(short):
        order = np.argsort(doc, kind="stable")
        values, doc = values[order], doc[order]
    for i, j in zip(edges[:-1], edges[1:]):
        values[i:j].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[keep], doc[keep]
    out = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(doc, minlength=len(texts)), out=out[1:])
    return values, out
