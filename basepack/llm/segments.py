"""Repeated windows across documents: candidate segments by anchors, matched in shards.

A window's anchor is its minimal k-gram, so equal windows have equal anchors.  Windows that share
an anchor form a run, whose symbols are a segment.  Only segments whose anchor occurs more than
once can hold a repeated window; those go to the shard of their anchor, where an index over the
shard's segments decides.  An anchor that more than ``hot`` batches have would gather too much in a
shard, most of it neighbours of a common passage that differ everywhere: there the windows' own
hashes are asked for first, and only what is repeated of a segment goes on, which is alike in most
batches.  Equal segments of a batch are sent once: all but the earliest are repeats as they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ..workspace import Workspace
from . import batches as B
from . import kernels as K

HOT_BATCHES = 1000
#: Bytes of text for each shard.
SHARD_BYTES = 1 << 20
#: Symbols of which anchors are computed at once.
PART_SYMBOLS = 1 << 16
_SCHEMA = "kind string, bucket long, batch long, blob binary"


@dataclass
class Block:
    """Symbols of a batch: ``symbols(i, j)`` hashes them, ``data[lo[i]:hi[j]]`` are the bytes of symbols i to j."""

    symbols: Callable[[int, int], np.ndarray]
    bounds: np.ndarray
    data: bytes
    lo: np.ndarray | None
    hi: np.ndarray | None

    def piece(self, start: int, last: int) -> bytes:
        return self.data[start : last + 1] if self.lo is None else self.data[self.lo[start] : self.hi[last]]


@dataclass
class Shard:
    """Distinct segments of a shard; ``key`` orders their earliest occurrences."""

    pieces: list[bytes]
    first: np.ndarray
    start: np.ndarray


def _parts(bounds: np.ndarray, window: int) -> Iterator[np.ndarray]:
    """Bounds of the parts: whole documents, and of a longer document pieces that overlap by window - 1 symbols."""
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PART_SYMBOLS, side="right")) - 1)
        if bounds[to] - bounds[at] <= PART_SYMBOLS:
            yield bounds[at : to + 1]
        else:
            for i in range(int(bounds[at]), int(bounds[to]) - window + 1, PART_SYMBOLS):
                yield np.array([i, min(i + PART_SYMBOLS + window - 1, int(bounds[to]))])
        at = to


def _anchors(block: Block, window: int, k: int):
    """(first window, last window, anchor) of all runs, from parts that bound the memory; cuts leave no trace."""
    empty = np.empty(0, np.int64)
    parts = [(empty, empty, empty, empty.astype(np.uint64))]
    for bounds in _parts(block.bounds, window):
        base = bounds[0]
        grams = K.gram_hashes(block.symbols(int(base), int(bounds[-1])), k)
        first, last, place = K.anchored_runs(grams, bounds - base, window, k)
        parts.append((first + base, last + base, place + base, grams[place]))
    first, last, place, anchor = (np.concatenate(x) for x in zip(*parts))
    new = np.ones(len(first) + 1, bool)
    new[1:-1] = (first[1:] != last[:-1] + 1) | (place[1:] != place[:-1])
    # Anchors are minimal hashes, so most are small; mixed again they deal evenly to buckets and shards.
    return first[new[:-1]], last[new[1:]], K.mix(anchor[new[:-1]])


def _pack(arrays: list[np.ndarray], data: bytes) -> bytes:
    parts = [a.tobytes() for a in arrays]
    head = np.array([len(arrays[0]), *(len(p) for p in parts)], np.int64).tobytes()
    return zstandard.compress(head + b"".join(parts) + data, 3)


def _unpack(blob: bytes, types: tuple) -> tuple[list[np.ndarray], bytes]:
    raw = B.unpack(blob)
    head = np.frombuffer(raw[: 8 * (len(types) + 1)], np.int64)
    at, out = 8 * (len(types) + 1), []
    for n, t in zip(head[1:], types):
        out.append(np.frombuffer(raw[at : at + n], t))
        at += int(n)
    return out, raw[at:]


@dataclass
class Runs:
    """Segments of a batch: document, window starts there and in the batch, last window, shard's key, symbols."""

    who: np.ndarray
    local: np.ndarray
    start: np.ndarray
    end: np.ndarray
    route: np.ndarray
    pieces: list[bytes]

    def take(self, at: np.ndarray) -> Runs:
        return Runs(self.who[at], self.local[at], self.start[at], self.end[at], self.route[at], [self.pieces[i] for i in at.tolist()])

    def first(self, within: bool) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the segments that no equal one precedes, and of the others."""
        order = np.lexsort((self.start, self.local, self.who) if within else (self.start, self.who))
        seen: dict[bytes, tuple] = {}
        send, sure = [], []
        for i in order.tolist():
            key = (self.who[i], self.local[i]) if within else self.who[i]
            (sure if seen.setdefault(self.pieces[i], key) < key else send).append(i)
        return np.array(send, np.int64), np.array(sure, np.int64)


def _spans(batch: int, runs: Runs, window: int) -> Iterator[dict]:
    if len(runs.start):
        yield {"kind": ["span"], "bucket": [None], "batch": [batch], "blob": [B.pack(np.stack([runs.start, runs.end + window]).astype(np.int64).tobytes())]}


def _to_shards(batch: int, runs: Runs, shards: int, parts: int) -> Iterator[dict]:
    for b, at in B.by_bucket(B.bucket_of(runs.route, shards)):
        r = runs.take(at)
        yield {"kind": ["segment"], "bucket": [b], "batch": [batch], "blob": [_pack([r.who, r.local, r.start, np.array([len(x) for x in r.pieces], np.int32), (r.route % np.uint64(parts)).astype(np.uint8)], b"".join(r.pieces))]}


def _windows(read: Callable, text_col: str, pieces: list[bytes], window: int) -> tuple[Block, np.ndarray, np.ndarray]:
    """(pieces as a block, positions of their windows there, the windows' hashes)."""
    block = read(pa.table({text_col: pa.array(pieces, pa.binary())}))
    at = K.spread(block.bounds[:-1], np.diff(block.bounds) - window + 1)
    hashed = [np.empty(0, np.uint64)]
    for i, j in zip(cuts := np.searchsorted(at, np.arange(0, int(block.bounds[-1]) + PART_SYMBOLS, PART_SYMBOLS)), cuts[1:]):
        if j > i:
            hashed.append(K.gram_hashes(block.symbols(int(at[i]), int(at[j - 1]) + window), window)[at[i:j] - at[i]])
    return block, at, np.concatenate(hashed)


def _segments(read: Callable, id_col: str, text_col: str, window: int, k: int, shards: int, parts: int, buckets: int, within: bool):
    """within: a start counts as earlier in the same document also."""

    def run(batch: int, table: pa.Table, answers: pa.Table) -> Iterator[dict]:
        block, ids = read(table), B.ids_of(table, id_col)
        first, last, anchor = _anchors(block, window, k)
        code = B.repeated_of(anchor, answers)
        for hot in (False, True):
            at = np.flatnonzero(code == 1 + hot)
            if not len(at):
                continue
            start, end = first[at], last[at]
            doc = np.searchsorted(block.bounds, start, side="right") - 1
            runs = Runs(ids[doc], start - block.bounds[doc], start, end, anchor[at], [block.piece(i, j + window - 1) for i, j in zip(start.tolist(), end.tolist())])
            send, sure = runs.first(within)
            yield from _spans(batch, runs.take(sure), window)
            runs = runs.take(send)
            if not hot:
                yield from _to_shards(batch, runs, shards, parts)
                continue
            for b, batch_, blob in ((r["bucket"], r["batch"], r["blob"]) for r in B.ask_repeated(batch, _windows(read, text_col, runs.pieces, window)[2], buckets)):
                yield {"kind": ["ask"], "bucket": b, "batch": batch_, "blob": blob}
            yield {"kind": ["hot"], "bucket": [None], "batch": [batch], "blob": [_pack([runs.who, runs.local, runs.start, runs.route, np.array([len(x) for x in runs.pieces], np.int32)], b"".join(runs.pieces))]}

    return run


def _trimmed(read: Callable, text_col: str, window: int, shards: int, parts: int, within: bool):
    """What is repeated of the segments of hot anchors."""

    def run(batch: int, blob: bytes, answers: pa.Table) -> Iterator[dict]:
        (who, local, start, route, size), data = _unpack(blob, (np.int64, np.int64, np.int64, np.uint64, np.int32))
        cut = np.concatenate([[0], np.cumsum(size)]).tolist()
        block, at, keys = _windows(read, text_col, [data[i:j] for i, j in zip(cut, cut[1:])], window)
        again = np.zeros(int(block.bounds[-1]) + 1, bool)
        again[at] = B.repeated_of(keys, answers) > 0
        i, j = K.runs_of(again)  # within pieces: the last window - 1 symbols of a piece are no window's start
        piece = np.searchsorted(block.bounds, i, side="right") - 1
        by = i - block.bounds[piece]
        runs = Runs(who[piece], local[piece] + by, start[piece] + by, start[piece] + by + j - 1 - i, route[piece], [block.piece(a, z + window - 2) for a, z in zip(i.tolist(), j.tolist())])
        send, sure = runs.first(within)
        yield from _spans(batch, runs.take(sure), window)
        yield from _to_shards(batch, runs.take(send), shards, parts)

    return run


def _matched(match: Callable, window: int, within: bool):
    """match(Shard) -> (segment, first window, last window) of the repeated windows of the earliest occurrences."""

    def run(table: pa.Table) -> Iterator[dict]:
        batch, who, local, start, piece_of, part, base, data = [], [], [], [], [], [], 0, []
        for b, blob in zip(table.column("batch").to_pylist(), table.column("blob")):
            (w, l, s, n, p), text = _unpack(blob.as_py(), (np.int64, np.int64, np.int64, np.int32, np.uint8))
            batch.append(np.full(len(w), b)), who.append(w), local.append(l), start.append(s), part.append(p)
            piece_of.append(np.stack([np.cumsum(n) - n, np.cumsum(n)]).astype(np.int64) + base)
            data.append(text)
            base += len(text)
        batch, who, local, start, part = map(np.concatenate, (batch, who, local, start, part))
        lo, hi = np.concatenate(piece_of, axis=1)
        data = b"".join(data)
        found = []
        for _, at in B.by_bucket(part):
            pieces = [data[i:j] for i, j in zip(lo[at].tolist(), hi[at].tolist())]
            found.append(one(batch[at], who[at], local[at], start[at], pieces))
        batch, begin, end = (np.concatenate(x) for x in zip(*found))
        batches, number = np.unique(batch, return_inverse=True)
        for i, at in B.by_bucket(number):
            yield {"batch": [batches[i]], "blob": [B.pack(np.stack([begin[at], end[at]]).astype(np.int64).tobytes())]}

    def one(batch, who, local, start, pieces):
        """(batch, begin, end) of the covered symbols of one part of a shard."""
        number: dict[bytes, int] = {}
        seg = np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.int64, len(pieces))
        del pieces
        order = np.lexsort((local, who, seg))
        head = np.ones(len(order), bool)
        head[1:] = seg[order][1:] != seg[order][:-1]
        lead = order[head]
        later = who > who[lead][seg]
        if within:
            later |= (who == who[lead][seg]) & (local > local[lead][seg])
        shard = Shard(list(number), who[lead], local[lead])
        size, which, a, z = match(shard)
        # Whole segments behind the earliest one, and the windows found in the earliest ones.
        full = np.flatnonzero(later)
        rest = np.flatnonzero(~later)
        by = rest[np.argsort(seg[rest], kind="stable")]
        lo, hi = np.searchsorted(seg[by], which), np.searchsorted(seg[by], which, side="right")
        rows, again = by[K.spread(lo, hi - lo)], np.repeat(np.arange(len(which)), hi - lo)
        row = np.concatenate([full, rows])
        begin = np.concatenate([start[full], start[rows] + a[again]])
        end = np.concatenate([start[full] + size[seg[full]], start[rows] + z[again] + window])
        return batch[row], begin, end

    return run


class Repeats:
    """Symbols of each document that repeated windows cover.  A shard is matched in ``parts``, by anchor, one after another."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, read: Callable, match: Callable, window: int, k: int, within: bool, name: str, parts: int, hot: int = HOT_BATCHES, shard_bytes: int = SHARD_BYTES, **sizes):
        self.ws = ws = Workspace(df.sparkSession, name)
        self.schema = df.schema
        self.read = read
        self.batches = batches = B.Batches(df, text_col, ws, **sizes)
        buckets = batches.buckets
        shards = max(1, buckets * sizes.get("bucket_bytes", B.BUCKET_BYTES) // shard_bytes)

        def ask(batch, table):
            yield from B.ask_repeated(batch, _anchors(read(table), window, k)[2], buckets)

        codes = B.repeated(batches.ask(ask, B.ASK_REPEATED), hot)
        found = ws.write("found", batches.give(codes, _segments(read, id_col, text_col, window, k, shards, parts, buckets, within), _SCHEMA), "kind")
        asked = found.where("kind = 'ask'").select("bucket", "batch", "blob")
        if not asked.isEmpty():
            hot_runs = found.where("kind = 'hot'").select("batch", "blob")
            trimmed = ws.write("trimmed", B.give_rows(hot_runs, B.repeated(asked, hot), _trimmed(read, text_col, window, shards, parts, within), _SCHEMA), "kind")
            found = found.where("kind in ('span', 'segment')").unionByName(trimmed)
        matched = B.answer(found.where("kind = 'segment'").select("bucket", "batch", "blob"), _matched(match, window, within), "batch long, blob binary")
        self.spans = found.where("kind = 'span'").select("batch", "blob").union(matched)

    def apply(self, fn: Callable, schema: str) -> DataFrame:
        """``fn(documents, block, mask of the covered symbols)`` for every batch."""
        read = self.read

        def run(batch, table, answers):
            block = read(table)
            pairs = [np.frombuffer(B.unpack(x), np.int64).reshape(2, -1) for x in answers.column("blob").to_pylist()]
            pairs = np.concatenate([np.empty((2, 0), np.int64), *pairs], axis=1)
            yield from fn(table, block, K.covered(int(block.bounds[-1]), pairs[0], pairs[1]))

        return self.batches.give(self.spans, run, schema)
