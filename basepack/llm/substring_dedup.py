"""Substring dedup: a compressed FM-index for each shard, searched backwards for documents' segments.

A shard's segments, words as symbols, form one text.  Its index keeps the Burrows-Wheeler transform in
a wavelet tree shaped by the words' frequencies (each word costs about the bits of its information),
the common prefix of neighbouring rows (a byte each, up to the window) and each row's age, which is its
place in the order of (document, start); neither text nor suffix array stays.  Documents' segments
stream through it from the last word to the first.  A backward step extends the match to the left;
where it fails the match falls back to its parent, which is shorter on the right, and beyond the
window's length it shrinks to the window.  That gives each position its matching statistic, up to the
window, and the interval of rows where the match stands.  Where the statistic reaches the window, the
least age in the interval tells whether the window also starts earlier; such intervals are reported.

Null texts and texts without words have none.  Rows with equal doc_id count as one document whose
starts decide; a null doc_id counts as larger than all others.  Repeats are judged on the input.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import batches as B
from . import kernels as K
from . import words as W
from .names import ddl
from .segments import Block, Repeats, Shard

WINDOW = 20
GRAM = 6
#: Parts of a shard; an index is the faster the more segments stream through it at once.
PARTS = 4


def read_words(text_col: str):
    def run(table: pa.Table) -> Block:
        data, lo, hi, bounds = W.places(B.texts_of(table, text_col))
        return Block(lambda i, j: W.place_hashes(data, lo[i:j], hi[i:j]), bounds, data, lo, hi)

    return run


class Bits:
    """Packed bits with the number of ones before each word of 64."""

    def __init__(self, bit: np.ndarray):
        pad = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
        pad[: len(bit)] = bit
        self.words = np.packbits(pad, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.uint32)
        self.before[1:] = np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.uint32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        inside = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word].astype(np.int64) + np.bitwise_count(inside)


class WaveletTree:
    """Ranks of symbols in a sequence, by levels of packed bits; a frequent symbol has a short code."""

    def __init__(self, x: np.ndarray, symbols: int):
        n, counts = max(1, len(x)), np.bincount(x, minlength=symbols)
        self.length = np.ceil(np.log2(n / np.maximum(counts, 1))).astype(np.int64).clip(1)
        self.length[counts == 0] = 0
        used = np.flatnonzero(counts)
        used = used[np.argsort(self.length[used], kind="stable")]
        deepest = int(self.length.max(initial=0))
        width = np.int64(1) << (deepest - self.length[used])
        code = np.zeros(symbols, np.int64)
        code[used] = (np.cumsum(width) - width) >> (deepest - self.length[used])
        self.code, self.levels = code, []
        start = np.zeros(symbols, np.int64)
        for level in range(deepest):
            bit_of = (code >> np.maximum(self.length - 1 - level, 0)) & 1
            bit = bit_of[x]
            bits = Bits(bit)
            first = bits.ones(start)
            self.levels.append((bits, start.astype(np.int32), first.astype(np.int32)))
            # Zeros go before ones; symbols whose code ends here go altogether.
            x = np.concatenate([x[bit == 0], x[bit == 1]])
            start = np.where(bit_of == 1, len(bit) - int(bit.sum()) + first, start - first)
            stays = self.length[x] > level + 1
            gone = np.concatenate([[0], np.cumsum(~stays)])
            x, start = x[stays], start - gone[np.minimum(start, len(stays))]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        i, out, lane = i.copy(), np.zeros(len(i), np.int64), np.flatnonzero(self.length[symbol] > 0)
        i, symbol = i[lane], symbol[lane]
        length, code = self.length[symbol], self.code[symbol]
        shortest = int(length.min(initial=1))
        for level, (bits, start, first) in enumerate(self.levels):
            if level >= shortest:
                done = length == level
                if done.any():
                    out[lane[done]] = i[done]
                    live = ~done
                    i, symbol, length, code, lane = i[live], symbol[live], length[live], code[live], lane[live]
                    if not len(lane):
                        break
            ones = bits.ones(start[symbol] + i) - first[symbol]
            i = np.where((code >> (length - 1 - level)) & 1, ones, i - ones)
        out[lane] = i
        return out


def suffix_order(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by what follows them, beyond the window; and neighbours' common prefixes, up to the window."""
    ranks, span = [K.ranks(text)], 1
    while span <= window:
        key = ranks[-1] * np.int64(len(text) + 2)
        key[:-span] += ranks[-1][span:] + np.int64(1)
        ranks.append(K.ranks(key))
        span *= 2
    order = np.argsort(ranks.pop())
    p, q = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(p), np.int64)
    for rank in reversed(ranks):
        span //= 2
        inside = np.maximum(p, q) < len(text)
        same = inside.copy()
        same[inside] = rank[p[inside]] == rank[q[inside]]
        p, q, common = p + span * same, q + span * same, common + span * same
    return order, np.concatenate([[0], np.minimum(common, window)])


class FMIndex:
    """Of a text of symbols >= 1 in which 0 ends each piece; ``age`` of each position."""

    def __init__(self, text: np.ndarray, window: int, age: np.ndarray):
        order, common = suffix_order(text, window)
        self.n, self.window = len(text), window
        counts = np.bincount(text)
        self.less = np.concatenate([[0], np.cumsum(counts)])
        self.tree = WaveletTree(text[order - 1], len(counts))
        self.common = np.append(common, 0).astype(np.uint8 if window < 256 else np.int32)
        first = common < window
        self.first = Bits(first)
        self.rows = np.append(np.flatnonzero(first), self.n)
        self.age = age[order].astype(np.int32)

    def least_age(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Range minimum of the ages in each interval of rows."""
        if not len(lo):
            return np.empty(0, np.int32)
        some, which = np.unique(lo * np.int64(self.n + 1) + hi, return_inverse=True)
        edges = np.stack([some // (self.n + 1), some % (self.n + 1)], axis=1).ravel()
        return np.minimum.reduceat(np.append(self.age, np.iinfo(np.int32).max), edges)[::2][which]

    def _parent(self, lo: np.ndarray, hi: np.ndarray):
        """(interval, length) of the longest shorter match that stands in more rows."""
        length = np.maximum(self.common[lo], self.common[hi]).astype(np.int64)
        lo, hi = lo.copy(), hi.copy()
        while (up := (self.common[lo] >= length) & (lo > 0)).any():
            lo[up] -= 1
        while (down := (self.common[hi] >= length) & (hi < self.n)).any():
            hi[down] += 1
        return lo, hi, length

    def statistics(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(length, first row, row behind the last) of the longest match, up to the window, from each position of the patterns.

        Patterns are symbols[start:end], all streamed at once from their ends; -1 is a symbol the text lacks.
        """
        length_at, lo_at, hi_at = (np.zeros(len(symbols), np.int64) for _ in range(3))
        lane = np.argsort(starts - ends, kind="stable")
        sizes = (ends - starts)[lane]
        lo, hi, length = np.zeros(len(lane), np.int64), np.full(len(lane), self.n, np.int64), np.zeros(len(lane), np.int64)
        for t in range(int(sizes.max(initial=0))):
            alive = int(np.searchsorted(-sizes, -t, side="left"))
            lane, lo, hi, length = lane[:alive], lo[:alive], hi[:alive], length[:alive]
            pos = ends[lane] - 1 - t
            todo = np.arange(alive)
            while len(todo):
                c = symbols[pos[todo]]
                known = (c >= 0) & (c < len(self.less) - 1)
                lost, todo, c = todo[~known], todo[known], c[known]
                lo[lost], hi[lost], length[lost] = 0, self.n, 0
                both = self.less[np.concatenate([c, c])] + self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[todo], hi[todo]]))
                a, z = both[: len(c)], both[len(c) :]
                ok = a < z
                good, bad = todo[ok], todo[~ok]
                lo[good], hi[good], length[good] = a[ok], z[ok], length[good] + 1
                todo = bad[length[bad] > 0]
                if len(bad):
                    none = bad[length[bad] == 0]
                    lo[none], hi[none] = 0, self.n
                    lo[todo], hi[todo], length[todo] = self._parent(lo[todo], hi[todo])
            over = np.flatnonzero(length > self.window)
            if len(over):
                row = self.first.ones(lo[over] + 1) - 1
                lo[over], hi[over], length[over] = self.rows[row], self.rows[row + 1], self.window
            length_at[pos], lo_at[pos], hi_at[pos] = length, lo, hi
        return length_at, lo_at, hi_at


def match(window: int):
    def run(shard: Shard):
        number: dict[bytes, int] = {}
        symbols: list[int] = []
        sizes = np.zeros(len(shard.pieces), np.int64)
        for i, piece in enumerate(shard.pieces):
            ws = piece.split(b" ")
            sizes[i] = len(ws)
            symbols += [number.setdefault(w, len(number) + 1) for w in ws]
            symbols.append(0)
        text = np.array(symbols, np.int64)
        del symbols, number
        ends = np.cumsum(sizes + 1) - 1  # of each piece's words
        # Order of all window starts by (document, start), equal for equal pairs.
        starts = ends - sizes
        at = K.spread(starts, sizes - window + 1)
        seg = np.repeat(np.arange(len(sizes)), sizes - window + 1)
        doc, place = shard.first[seg], shard.start[seg] + at - starts[seg]
        by = np.lexsort((place, doc))
        step = np.zeros(len(by), np.int64)
        step[1:] = (doc[by][1:] != doc[by][:-1]) | (place[by][1:] != place[by][:-1])
        age = np.full(len(text), len(text) + 1, np.int64)
        age[at[by]] = np.cumsum(step)
        index = FMIndex(text, window, age)
        length, lo, hi = index.statistics(text, starts, ends)
        again = np.flatnonzero((length == window) & (hi - lo > 1))
        found = np.zeros(len(text) + 1, bool)
        found[again] = index.least_age(lo[again], hi[again]) < age[again]
        i, j = K.runs_of(found)
        which = np.searchsorted(ends, i, side="right")
        return sizes, which, i - starts[which], j - 1 - starts[which]

    return run


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, **sizes) -> Repeats:
    return Repeats(df, id_col, text_col, read_words(text_col), match(window), window, gram, True, "substring", PARTS, **sizes)


def _kept(block: Block, mask: np.ndarray):
    """(words, removed words, kept words joined by one space) of each document."""
    for i, j in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist()):
        removed = int(np.count_nonzero(mask[i:j]))
        if i == j:
            yield 0, 0, b""
        elif not removed:
            yield j - i, 0, block.piece(i, j - 1)
        else:
            a, b = K.runs_of(~mask[i:j])
            yield j - i, removed, b" ".join(block.piece(i + s, i + e - 1) for s, e in zip(a.tolist(), b.tolist()))


def digests(found: Repeats, id_col: str = "doc_id") -> DataFrame:
    def run(table, block, mask):
        n, r, h = zip(*((n, r, hashlib.sha256(kept).hexdigest()) for n, r, kept in _kept(block, mask)))
        yield {"doc_id": table.column(id_col).cast(pa.int64()).combine_chunks(), "n_words": n, "n_removed": r, "kept_sha256": h}

    return found.apply(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(found: Repeats, text_col: str = "text") -> DataFrame:
    """The input's rows; texts that lose words become their kept words joined by one space."""
    names = found.schema.names

    def run(table, block, mask):
        old = table.column(text_col).to_pylist()
        new = [kept.decode() if r else o for o, (_, r, kept) in zip(old, _kept(block, mask))]
        yield {c: pa.array(new, pa.string()) if c == text_col else table.column(c).combine_chunks() for c in names}

    return found.apply(run, ddl(found.schema))


def op1_fm_index_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(repeats(docs))


SQL = rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, i, list_slice(words, i, i + {WINDOW - 1}) AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
r AS (
  SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
p AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM r),
g AS (
  SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
u AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (
  SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS t FROM u ANTI JOIN p ON p.doc_id = u.doc_id AND p.i = u.i GROUP BY u.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
