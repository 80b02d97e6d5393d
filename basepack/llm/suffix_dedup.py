"""Suffix-array dedup: longest-previous-factor arrays remove later copies and keep the first.

A shard's segments are concatenated and their suffixes sorted by doubling ranks.  In suffix order,
the previous and the next suffix of a smaller document are a suffix's best earlier matches; the
larger of the two common prefixes is its longest previous factor (measured beyond the window).
Where it reaches the window, the window's bytes go.

Null and empty texts have no bytes.  Rows with equal doc_id never remove from each other; a null
doc_id counts as larger than all others.  Texts are judged on the input, whole, as UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import batches as B
from . import caches
from . import kernels as K
from .names import ddl
from .segments import Block, Repeats, Shard

WINDOW = 50
GRAM = 20
#: Parts of a shard; sorting is faster where a part fits the processor's cache.
PARTS = 16

_TABLE = K.mix(np.arange(1, 257, dtype=np.uint64))


def read_bytes(text_col: str):
    def run(table: pa.Table) -> Block:
        caches.use("bytes")
        texts = B.texts_of(table, text_col)
        data = b"".join(texts)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        return Block(lambda i, j: _TABLE[np.frombuffer(data, np.uint8)[i:j]], bounds, data, None, None)

    return run


def depth_of(window: int) -> int:
    """Bytes to which suffixes are sorted: a power of two above the window."""
    return max(16, 1 << window.bit_length())


def suffix_ranks(x: np.ndarray, depth: int) -> dict[int, np.ndarray]:
    """Ranks of all positions by their next 8, 16, 32, ... and ``depth`` bytes; zeros follow the end."""
    padded = np.concatenate([x, np.zeros(8, np.uint8)]).astype(np.uint64)
    key, span = padded, 1
    while span < 8:
        key = (key[:-span] << np.uint64(8 * span)) | key[span:]
        span *= 2
    out = {8: K.ranks(key[: len(x)])}
    while span < depth:
        r = out[span]
        key = r * np.int64(len(r) + 2)
        key[:-span] += r[span:] + np.int64(1)
        out[span * 2] = K.ranks(key)
        span *= 2
    return out


def common_prefixes(rank: dict[int, np.ndarray], x: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at p and q, up to a byte less than the ranks' depth."""
    p, q, out, n = p.copy(), q.copy(), np.zeros(len(p), np.int64), len(x)
    for span in sorted(rank, reverse=True)[1:]:
        inside = np.maximum(p, q) < n
        same = inside.copy()
        same[inside] = rank[span][p[inside]] == rank[span][q[inside]]
        p, q, out = p + span * same, q + span * same, out + span * same
    open_ = np.ones(len(p), bool)
    for _ in range(7):
        open_ &= np.maximum(p, q) < n
        open_[open_] = x[p[open_]] == x[q[open_]]
        p, q, out = p + open_, q + open_, out + open_
    return out


def previous_factors(value: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Length of the longest match, in suffix order, with a smaller value above; 0 where it falls under ``least``.

    lcp[i]: common prefix of suffixes i - 1 and i.  Pointers jump over larger values, all at once.
    """
    n = len(value)
    best = lcp.copy()
    to = np.arange(-1, n - 1)
    live = np.flatnonzero((best >= least) & (to >= 0))
    best[(best < least) | (to < 0)] = 0
    while len(live):
        up = live[value[to[live]] >= value[live]]
        if not len(up):
            break
        via = to[up]
        reach = np.minimum(best[up], best[via])
        dead = (reach < least) | (to[via] < 0)
        best[up] = np.where(dead, 0, reach)
        to[up] = to[via]
        live = up[~dead]
    return best


def match(window: int):
    def run(shard: Shard):
        sizes = np.array([len(p) for p in shard.pieces], np.int64)
        x = np.frombuffer(b"".join(shard.pieces), np.uint8)
        ends = np.cumsum(sizes)
        starts = K.spread(ends - sizes, sizes - window + 1)
        seg = np.repeat(np.arange(len(sizes)), sizes - window + 1)
        depth = depth_of(window)
        rank = suffix_ranks(x, depth)
        order = np.argsort(rank[depth][starts])
        at, owner = starts[order], seg[order]
        value = shard.first[owner]
        lcp = np.zeros(len(at), np.int64)
        if len(at) > 1:
            lcp[1:] = common_prefixes(rank, x, at[:-1], at[1:])
        before = previous_factors(value, lcp, window)
        back = np.zeros(len(at), np.int64)
        back[1:] = lcp[:0:-1]
        after = previous_factors(value[::-1], back, window)[::-1]
        found = np.zeros(len(x) + 1, bool)
        found[at[np.maximum(before, after) >= window]] = True
        i, j = K.runs_of(found)
        # A run of found starts does not pass the end of a segment: no start lies in its last bytes.
        which = np.searchsorted(ends, i, side="right")
        base = (ends - sizes)[which]
        return sizes, which, i - base, j - 1 - base

    return run


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, **sizes) -> Repeats:
    return Repeats(df, id_col, text_col, read_bytes(text_col), match(window), window, gram, False, "suffix", PARTS, **sizes)


def _each(block: Block, mask: np.ndarray):
    """(bytes, removed bytes, removed runs, kept bytes) of each document."""
    for i, j in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist()):
        m = mask[i:j]
        removed = int(np.count_nonzero(m))
        if not removed:
            yield j - i, 0, 0, block.data[i:j]
        else:
            a, b = K.runs_of(m)
            cut = np.concatenate([[0], b]).tolist(), np.concatenate([a, [j - i]]).tolist()
            yield j - i, removed, len(a), b"".join(block.data[i + s : i + e] for s, e in zip(*cut))


def digests(found: Repeats, id_col: str = "doc_id") -> DataFrame:
    def run(table, block, mask):
        rows = [(n, r, s, hashlib.sha256(kept).hexdigest()) for n, r, s, kept in _each(block, mask)]
        n, r, s, h = zip(*rows)
        yield {"doc_id": table.column(id_col).cast(pa.int64()).combine_chunks(), "n_bytes": n, "n_removed": r, "n_spans": s, "kept_sha256": h}

    return found.apply(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(found: Repeats, text_col: str = "text") -> DataFrame:
    """The input's rows with what remains of each text; bytes of a character that was cut go too."""
    names = found.schema.names

    def run(table, block, mask):
        kept = [k.decode("utf-8", "ignore") if r else k.decode("utf-8", "replace") for _, r, _, k in _each(block, mask)]
        null = table.column(text_col).is_null().to_pylist()
        yield {c: pa.array([None if z else k for k, z in zip(kept, null)], pa.string()) if c == text_col else table.column(c).combine_chunks() for c in names}

    return found.apply(run, ddl(found.schema))


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(repeats(docs))


SQL = f"""
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, {2 * WINDOW}) AS k
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {WINDOW - 1})) AS i FROM b)),
m AS (
  SELECT k, min(doc_id) AS least FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
r AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WINDOW} THEN 0 ELSE 1 END AS new
  FROM s JOIN m USING (k) WHERE least < doc_id),
spans AS (
  SELECT doc_id, run, min(i) AS a, max(i) + {WINDOW} AS z
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r) GROUP BY doc_id, run),
cuts AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
  UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2, NULL FROM b),
pieces AS (
  SELECT c.doc_id, a, substr(h, (2 * coalesce(before, l.z, 0) + 1)::BIGINT, (2 * (a - coalesce(before, l.z, 0)))::BIGINT) AS piece
  FROM cuts c JOIN b USING (doc_id) LEFT JOIN (SELECT doc_id, max(z) AS z FROM spans GROUP BY doc_id) l ON l.doc_id = c.doc_id),
kept AS (
  SELECT doc_id, sha256(unhex(string_agg(piece, '' ORDER BY a, length(piece)))) AS kept_sha256 FROM pieces GROUP BY doc_id),
gone AS (
  SELECT doc_id, sum(z - a) AS n, count(*) AS c FROM spans GROUP BY doc_id)
SELECT b.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone.n, 0)::BIGINT AS n_removed, coalesce(gone.c, 0)::BIGINT AS n_spans, kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
