"""Signatures of sets for an exact similarity join by universe partitioning.

The symmetric difference of two sets that link is at most ``H``.  A hash deals the universe of
tokens into segments.  A segment of allowance 0 is indexed by its subset, one of allowance 1 also
by the subset's one-deletion neighbourhood, so that it still meets a partner's segment with a
difference of 1.  With allowances v, a pair that links has more than ``skips`` segments that meet,
as soon as sum(v + 1) >= H + 1 + skips * (max(v) + 1): a document may leave out up to ``skips``
costly signatures (of empty or very common subsets) and still meets each partner elsewhere.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import kernels as K

_U = np.uint64


@lru_cache(maxsize=64)
def bands(num: int, den: int) -> np.ndarray:
    """First sizes of the bands.  Sizes s <= t of linked sets lie in one band or in neighbours."""
    at = [1]
    while at[-1] < 1 << 40:
        at.append(at[-1] * den // num + 1)
    return np.array(at, np.int64)


@lru_cache(maxsize=4096)
def plan(band: int, num: int, den: int) -> tuple[int, int, int]:
    """(segments, allowance of each, signatures that may be left out) of a band.

    Cost-based: expected signatures, and expected meetings of unlike documents, which fall by a
    factor for each token of a segment.
    """
    first, top = (int(x) for x in bands(num, den)[band : band + 2])
    top -= 1
    partner = top * den // num
    h = (den - num) * (top + partner) // (den + num)
    best = None
    for v in (0, 1):
        skips = max(1, (h + 1) * 3 // 20) if h else 0
        m = -(-(h + 1 + skips * (v + 1)) // (v + 1))
        emitted = m + (v and top)
        cost = emitted * (1 + 100 * 0.3 ** (first / m))
        if best is None or cost < best[0]:
            best = (cost, (m, v, skips))
    return best[1]


def signatures(values: np.ndarray, bounds: np.ndarray, num: int, den: int):
    """(signature, document, 0 for its own band or 1 for the one below, signatures it may leave out there)."""
    sizes = np.diff(bounds)
    edges = bands(num, den)
    own = np.searchsorted(edges, sizes, side="right") - 1
    sig, doc, group, skip_of = [], [], [], []
    for below in (0, 1):
        band = own - below
        docs = np.flatnonzero((sizes > 0) & (band >= 0))
        for b in np.unique(band[docs]):
            m, v, skips = plan(int(b), num, den)
            here = docs[band[docs] == b]
            tokens = values[K.spread(bounds[here], sizes[here])]
            local = np.repeat(np.arange(len(here)), sizes[here])
            salt = K.mix(np.array([int(b) * 2 + 1], _U))[0]
            mixed = K.mix(tokens ^ salt)
            slot = local * m + (mixed % _U(m)).astype(np.int64)
            mixed = K.mix(mixed)
            sums = np.zeros(len(here) * m, _U)
            np.add.at(sums, slot, mixed)
            seg = K.mix((np.arange(m).astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15) + salt)
            each = np.tile(seg, len(here))
            sig.append(K.mix(sums ^ each))
            doc.append(np.repeat(here, m))
            if v:
                less = K.mix((sums[slot] - mixed) ^ each[slot])
                sig.append(less)
                doc.append(here[local])
            emitted = len(here) * m + (len(local) if v else 0)
            group.append(np.full(emitted, below))
            skip_of.append(np.full(emitted, skips))
    if not sig:
        z = np.empty(0, np.int64)
        return np.empty(0, _U), z, z, z
    return np.concatenate(sig), np.concatenate(doc), np.concatenate(group), np.concatenate(skip_of)
