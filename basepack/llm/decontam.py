"""Benchmark decontamination: n-gram seeds that lose no leak, then Smith-Waterman alignment.

An item leaked if the local alignment (match 1, mismatch and gap -1, on words without case and
punctuation) scores THRESHOLD of its length or more; edited copies score less than 1, unrelated text
far less.  An alignment of that score leaves at least ``need`` n-grams of the item intact, at places
of their own (see ``intact``).  So all but need - 1 of an item's n-grams are seeds, those that the
most documents hold being left out: every leak holds a seed.  Documents that hold one are aligned
with its item around the place the seed suggests, if ``need`` n-grams of the item are there.

Items go to all tasks in blocks of BLOCK_BYTES of text, two passes over the documents for each block;
documents are never shuffled.  Items of fewer than LEAST_WORDS words match nothing, since any text may
hold them by chance; ``short_items`` lists them.  Null and empty texts match nothing.

Each row is judged for itself: rows that repeat a doc_id, or whole rows, give rows of their own, and
``decontaminated`` drops only those that hold an item.  Items that repeat an item_id are items of
their own; of each row and item_id the best alignment is reported.  A null doc_id or item_id stays
null.  Of alignments with equal scores the first in the text counts.  Empty tables give no leaks.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace, ship
from . import caches
from . import kernels as K
from .names import ddl

#: Longest n-grams; an item has the longest of which each of its leaks holds one.
GRAM = 3
THRESHOLD = 0.5
BLOCK_BYTES = 8 << 20
#: Fewest words of an item that is looked for.
LEAST_WORDS = 4
_FOLD = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))


def tokens(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def least_score(m: int, threshold: float) -> int:
    """Score from which an item of m words leaked."""
    return max(1, math.ceil(threshold * m))


def intact(m: int, score: int, n: int) -> int:
    """n-grams of an item of m words, at least, that an alignment of ``score`` leaves intact.

    With M matches and M - score errors or fewer, the matches form M - score + 1 runs at most, and
    a run of r holds r - n + 1 n-grams or more; linear in M, which is between the score and m.
    """
    return min(score - n + 1, m - (n - 1) * (m - score + 1))


class Items:
    """A block of benchmark items: word numbers, and the n-grams with their places."""

    def __init__(self, rows: list[tuple[int, list[bytes]]], gram: int, threshold: float = THRESHOLD):
        self.ids = [i for i, _ in rows]
        self.number: dict[bytes, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in ws], np.int64) for _, ws in rows]
        self.least = [least_score(len(w), threshold) for w in self.words]
        item, at, key, grams, need = [], [], [], [], []
        for i, (w, s) in enumerate(zip(self.words, self.least)):
            n = max([n for n in range(1, gram + 1) if intact(len(w), s, n) > 0], default=1)
            g = self._keys(w, min(n, len(w)))
            grams.append(n), need.append(intact(len(w), s, n))
            item.append(np.full(len(g), i)), at.append(np.arange(len(g))), key.append(g)
        e = np.empty(0, np.int64)
        self.item, self.at, self.key = np.concatenate([e, *item]), np.concatenate([e, *at]), np.concatenate([np.empty(0, np.uint64), *key])
        self.lengths, self.need = np.unique(grams), np.array(need, np.int64)
        self.distinct, number = np.unique(self.key, return_inverse=True)
        bounds = np.searchsorted(self.item, np.arange(len(self.words) + 1)).tolist()
        #: Of each item, the indices in ``distinct`` of its n-grams.
        self.grams = [number[i:j].tolist() for i, j in zip(bounds, bounds[1:])]

    @staticmethod
    def _keys(words: np.ndarray, n: int) -> np.ndarray:
        return K.gram_hashes(K.mix(words.astype(np.uint64) + np.uint64(n << 40)), n) if n else np.empty(0, np.uint64)

    def number_of(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def hits(self, words: np.ndarray, distinct: np.ndarray):
        """(place in words, index in ``distinct``) of every n-gram of the words that is in ``distinct``."""
        places, index = [], []
        for n in self.lengths:
            if len(words) < n or not len(distinct):
                continue
            bad = np.concatenate([[0], np.cumsum(words == 0)])
            may = np.flatnonzero(bad[n:] == bad[:-n])
            if not len(may):
                continue
            keys = self._keys(words, int(n))[may]
            k = np.searchsorted(distinct, keys)
            k[k == len(distinct)] = 0
            ok = distinct[k] == keys
            places.append(may[ok]), index.append(k[ok])
        e = np.empty(0, np.int64)
        return np.concatenate([e, *places]), np.concatenate([e, *index])

    def seeds(self, documents: np.ndarray) -> np.ndarray:
        """Rows of the n-gram table that are seeds: all of an item but the need - 1 that the most documents hold."""
        order = np.lexsort((self.at, -documents[np.searchsorted(self.distinct, self.key)], self.item))
        place = np.arange(len(order)) - np.searchsorted(self.item, self.item)
        return np.sort(order[place >= self.need[self.item] - 1])

    def room(self, item: int) -> int:
        """Words by which the places that two n-grams of one leak suggest can differ, at most."""
        return len(self.words[item]) - self.least[item]


def smith_waterman(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, last word of that alignment) of an item with each row of passages (word 0 matches nothing)."""
    n, width = passages.shape
    h, best, end = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    ramp = np.arange(width + 1, dtype=np.int32)
    for w in item:
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(h[:, :-1] + np.where(passages == w, 1, -1), h[:, 1:] - 1)
        np.maximum(new, 0, out=new)
        h = np.maximum.accumulate(new + ramp, axis=1) - ramp  # gaps in the item, all at once
        top = h.argmax(axis=1)
        score = h[np.arange(n), top]
        end = np.where(score > best, top - 1, end)
        best = np.maximum(best, score)
    return best, end


def _candidates(items: Items, item: np.ndarray, start: np.ndarray):
    """Passages (item, first, last estimated start) from the starts that seeds suggest."""
    if not len(item):
        return item, start, start
    order = np.lexsort((start, item))
    item, start = item[order], start[order]
    length = np.array([len(w) for w in items.words])[item]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (start[1:] - start[:-1] > length[1:] // 2)
    head = np.flatnonzero(new)
    return item[head], start[head], start[np.append(head[1:], len(item)) - 1]


def _passages(items: Items, words: np.ndarray, place: np.ndarray, index: np.ndarray, candidates):
    """(item, place, words) of the candidates' passages that hold as many n-grams of the item as a leak does."""
    by = np.argsort(place, kind="stable")
    place, index = place[by], index[by]
    for item, first, last in zip(*(x.tolist() for x in candidates)):
        at, end = max(0, first - items.room(item)), last + len(items.words[item]) + items.room(item)
        held = set(index[np.searchsorted(place, at) : np.searchsorted(place, end)].tolist())
        if sum(g in held for g in items.grams[item]) >= items.need[item]:
            yield item, at, words[at:end]


def _align(items: Items, found: list):
    """Leaks among (document, item, place, passage), as (document, item, score, end)."""
    by: dict[int, list] = {}
    for doc, item, at, passage in found:
        by.setdefault(item, []).append((doc, at, passage))
    for item, rows in by.items():
        w = items.words[item]
        rows.sort(key=lambda r: len(r[2]))
        i = 0
        while i < len(rows):
            j = i + 1
            while j < len(rows) and (j - i + 1) * len(rows[j][2]) < 1 << 18:
                j += 1
            block = np.zeros((j - i, len(rows[j - 1][2])), np.int64)
            for k, r in enumerate(rows[i:j]):
                block[k, : len(r[2])] = r[2]
            for (doc, at, _), score, end in zip(rows[i:j], *smith_waterman(w, block)):
                if score >= items.least[item]:
                    yield doc, item, float(score) / len(w), int(at + end)
            i = j


def _best(found: Iterator[tuple]) -> dict[tuple, tuple]:
    """(row, item) to its best (score, -end)."""
    best: dict[tuple, tuple] = {}
    for row, item, score, end in found:
        best[row, item] = max(best.get((row, item), (0.0, 0)), (score, -end))
    return best


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, gram: int, threshold: float, block_bytes: int, least_words: int) -> Iterator[Items]:
    """The items, in blocks of bounded size that come to the driver one after another."""
    ws = Workspace(benchmark.sparkSession, "decontam")
    sized = ws.write("items", benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null"))
    total = sized.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        kept = [(r.item_id, w) for r in rows if len(w := tokens(r.text)) >= least_words]
        if kept:
            yield Items(kept, gram, threshold)


def short_items(benchmark: DataFrame, item_text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``benchmark`` that are too short to be looked for."""
    folded = F.regexp_replace(F.coalesce(F.col(item_text), F.lit("")), r"[!-/:-@\[-`{-~]", " ")
    words = F.filter(F.split(folded, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return benchmark.where(F.size(words) < least_words)


class _Search:
    """A block of items and its seeds; finds the leaks of rows of texts."""

    def __init__(self, items: Items, texts: DataFrame):
        self.items = items
        documents = np.zeros(len(items.distinct), np.int64)
        for r in texts.mapInArrow(self._count(items), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # n-grams of a block
            documents[r.k] = r.n
        chosen = items.seeds(documents)
        self.chosen = chosen[np.argsort(items.key[chosen], kind="stable")]
        keys = items.key[self.chosen]
        self.lo, self.hi = np.searchsorted(keys, items.distinct), np.searchsorted(keys, items.distinct, side="right")

    @staticmethod
    def _count(items: Items):
        def run(it):
            caches.use("decontam")
            n = np.zeros(len(items.distinct), np.int64)
            for rows in it:
                for t in rows.column(0):
                    _, index = items.hits(items.number_of(tokens(t.as_py())), items.distinct)
                    n[np.unique(index)] += 1
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"k": some, "n": n[some]})

        return run

    def __call__(self, texts: pa.Array) -> Iterator[tuple]:
        """(row, item, score, end) of all alignments that leaked."""
        items, lo, hi, found = self.items, self.lo, self.hi, []
        for row, t in enumerate(texts):
            words = items.number_of(tokens(t.as_py()))
            place, index = items.hits(words, items.distinct)
            uses = hi[index] - lo[index]
            use = self.chosen[K.spread(lo[index], uses)]
            start = np.repeat(place, uses) - items.at[use]
            found += [(row, *p) for p in _passages(items, words, place, index, _candidates(items, items.item[use], start))]
        return _align(items, found)


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, score, end_word): rows that hold an item, the best alignment of each row and item_id."""
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema, out = "doc_id long, item_id long, score double, end_word long", None
    for items in _blocks(benchmark, item_col, item_text, gram, threshold, block_bytes, least_words):
        part = docs.mapInArrow(_found(_Search(items, docs.select("text"))), schema)
        out = part if out is None else out.union(part)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def _found(search: _Search):
    def run(it):
        caches.use("decontam")
        for rows in it:
            for i in range(0, len(rows), 512):
                ids = rows.column(0).slice(i, 512).to_pylist()
                best = _best((row, search.items.ids[k], score, end) for row, k, score, end in search(rows.column(1).slice(i, 512)))
                if best:
                    (row, item), (score, end) = zip(*best), zip(*best.values())
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[r] for r in row], pa.int64()), "item_id": pa.array(item, pa.int64()), "score": pa.array(score, pa.float64()), "end_word": -np.array(end, np.int64)})

    return run


def _clean(search: _Search, text_col: str):
    def run(it):
        caches.use("decontam")
        for rows in it:
            for i in range(0, len(rows), 512):
                some = rows.slice(i, 512)
                keep = np.ones(len(some), bool)
                keep[[row for row, *_ in search(some.column(some.schema.get_field_index(text_col)))]] = False
                yield some.filter(pa.array(keep))

    return run


def decontaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``df`` that hold no item."""
    ship(df.sparkSession)
    texts, out = df.select(text_col), df
    for items in _blocks(benchmark, item_col, item_text, gram, threshold, block_bytes, least_words):
        out = out.mapInArrow(_clean(_Search(items, texts), text_col), ddl(df.schema))
    return out


def op7_smith_waterman_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
