"""Harmonic packing of tokenized documents into fixed-capacity sequences.

Class k holds pieces of capacity / (k + 1) to capacity / k tokens, and each of its bins k pieces.
Documents may be cut: whole sequences first, then the largest piece that fills its class exactly
(capacity // k tokens) and leaves nothing or at least LEAST tokens; what is left at the end, LEAST to
about 2 LEAST tokens (or a shorter document), goes whole into its own class.  So a document has few
pieces, a bin rarely more than capacity / LEAST, and padding is what the last pieces lack of their
classes.  A worker fills its own bins of each class; no worker needs to know of another.  The bins
that a worker has open at its end, less than one of each class, are poured together: their pieces
fill common sequences one after another, cut at the borders, and the last sequence is cut into
powers of two, so none of these needs padding.

Ids are those of the vocabulary's own tokenizer as it is loaded: special tokens that a text spells
out, as <|endoftext|>, are one id.  Null and empty texts are the end token alone.  Rows that repeat
a doc_id are documents of their own; a null doc_id stays null.  Texts are encoded whole.  An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import caches

CAPACITY = 2048
END = 1
_END = END.to_bytes(4, "little")
VOCABULARY = "byte_bpe_50k.json"

#: Fewest tokens that a cut leaves behind.
LEAST = 64
#: Where the byte-level splitter of the vocabulary cuts a text, as is published with it.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts of these characters only are split alike by every Unicode version, white space included.
_COMMON = re.compile("[\\t-\\r -~\xa1-\u024f\u2010-\u2027]*")
#: Characters of a block; a text with a block without a blank, or of white space only, may hold a run too long for the fast encoder.
_BLOCK = 1000


def _ranks(vocabulary: str) -> dict[bytes, int] | None:
    """The vocabulary's tokens and their ids, if merging by the smallest id is what its list of merges says."""
    with open(vocabulary, encoding="utf-8") as f:
        found = json.load(f)
    model, split = found["model"], found.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or found.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    # Bytes that print stand for themselves, the others for the characters from 256 on.
    printing = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(printing)))}
    added = {t["content"] for t in found.get("added_tokens", ())}
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    complete = len(ids) + 256 == len(ranks) and all(bytes([b]) in ranks for b in range(256))
    return ranks if complete and all(x < y for x, y in zip(ids, ids[1:])) else None


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit integers: those that ``tokenizers`` gives.

    Texts of common characters go through tiktoken, a faster encoder, with the same vocabulary's
    ranks; all others, and texts that spell out a special token, through ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = _ranks(vocabulary)
        self.fast = ranks and tiktoken.Encoding(vocabulary, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _exact(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _common(self, t: str) -> bool:
        if not _COMMON.fullmatch(t) or any(s in t for s in self.special):
            return False
        return not any(" " not in (block := t[i : i + _BLOCK]) or block.isspace() for i in range(0, len(t) - _BLOCK + 1, _BLOCK))

    def __call__(self, text: str) -> bytes:
        if self.fast and self._common(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).tobytes()
        return self._exact(text)


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """``name``: a file, or the name of one of the public vocabularies."""
    if name not in _encoders:
        path = name
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(name)
        _encoders[name] = Encoder(path)
    return _encoders[name]


@lru_cache(maxsize=8)
def cuts(capacity: int, least: int = LEAST) -> list[tuple[tuple[int, int, int], ...]]:
    """For each rest of fewer tokens than the capacity: (start, length, class) of its pieces."""
    exact = sorted({capacity // k for k in range(1, capacity + 1)})
    out: list[tuple] = [()]
    for n in range(1, capacity):
        if n <= 2 * least or n in exact:
            length = n
        else:
            length = exact[bisect_right(exact, n - least) - 1]
        k = capacity // length
        out.append(((0, length, k), *((s + length, m, c) for s, m, c in out[n - length])))
    return out


class Bins:
    """One worker's bins: gives (sequence, offset) to pieces (doc, start, length, tokens, doc_tokens), class by class."""

    def __init__(self, worker: int, capacity: int):
        self.sequence, self.capacity = worker << 32, capacity
        self.open: dict[int, list] = {}

    def add(self, k: int, piece: tuple) -> list[tuple]:
        """The pieces of the bin that this piece fills."""
        if k > 1:
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) < k:
                return []
            self.open[k] = []
        else:
            held = [piece]
        at, out, sequence = 0, [], self.sequence
        self.sequence += 1
        for p in held:
            out.append((*p, sequence, at))
            at += p[2]
        return out

    def rest(self) -> Iterator[tuple]:
        """The pieces of all open bins, poured into common sequences that need no padding."""
        pieces = [p for _, held in sorted(self.open.items()) for p in held]
        self.open.clear()
        left, room, at = sum(p[2] for p in pieces), 0, 0
        for doc, start, length, ids, n in pieces:
            done = 0
            while done < length:
                if at == room:
                    room, at = min(self.capacity, 1 << (left.bit_length() - 1)), 0
                    left -= room
                    self.sequence += 1
                m = min(length - done, room - at)
                yield doc, start + done, m, ids[4 * done : 4 * (done + m)], n, self.sequence - 1, at
                done, at = done + m, at + m


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """One row for each piece; ``ids`` adds its token ids.  ``capacity`` is a power of two."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(it):
        from pyspark import TaskContext

        caches.use("packing")
        encode, bins, table = encoder(vocabulary), Bins(TaskContext.get().partitionId(), capacity), cuts(capacity)
        crc32 = zlib.crc32

        def rows(pieces):
            doc, start, length, tokens, n, sequence, offset = zip(*pieces)
            out = [pa.array(doc, pa.int64()), *(pa.array(np.fromiter(x, np.int64, len(doc))) for x in (start, length, map(crc32, tokens), n, sequence, offset))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(tokens), "<i4"))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(out, names=names)

        for batch in it:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(docs), 512):
                full = []
                for doc, text in zip(docs[i : i + 512], texts.slice(i, 512)):
                    tokens = encode(text.as_py() or "") + _END
                    n = len(tokens) >> 2
                    whole = n - n % capacity
                    for start in range(0, whole, capacity):
                        full += bins.add(1, (doc, start, capacity, tokens[4 * start : 4 * (start + capacity)], n))
                    for start, length, k in table[n - whole]:
                        start += whole
                        full += bins.add(k, (doc, start, length, tokens[4 * start : 4 * (start + length)], n))
                if full:
                    yield rows(full)
        last = list(bins.rest())
        if last:
            yield rows(last)

    return df.select(df[id_col].cast("long"), df[text_col]).mapInArrow(run, _SCHEMA + (", ids array<int>" if ids else ""))


def op5_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
