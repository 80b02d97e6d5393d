"""N-gram Jaccard join by universe partitioning, pigeonhole and exact verification.

Signatures (see ``partitions``) are asked for once, in buckets; only those that two documents share
become rows.  Documents with equal sets are one node.  The nodes of a signature form a star around
the smallest of them; stars are verified on whole sets and give components.  What then still shares
a signature across components is compared by foldable sketches, whose differing cells are a lower
bound of the symmetric difference, so that only pairs that could link are verified.  A group's pairs
come in turns: the likeliest of each two components first, at most as many as the group has documents,
then eight times as many each; a pair whose components have met by then is left out.  Together this
finds every pair that connects components, without listing the pairs inside them.

Null or empty texts and texts without words have no shingles and link with nothing.  Rows that
repeat a doc_id are documents of their own; a null doc_id counts as larger than all others.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import batches as B
from . import kernels as K
from . import partitions, words
from .components import components
from .names import ddl

#: Documents of a signature beyond which it may be left out (if few of a document's are so common).
HOT = 64
#: Documents of a block of a signature's group.
BLOCK = 1024
#: Signatures of a document, the smallest, by which a pair is told to stand in an earlier group too.
KNOWN = 16
_ROW_BITS = 20
_FIRST = "kind string, row long, doc_id long, n long, hi long, lo long, bucket long, batch long, blob binary"


def _first(id_col: str, text_col: str, n: int, num: int, den: int, buckets: int):
    def run(batch: int, table: pa.Table):
        values, bounds = words.shingle_sets(B.texts_of(table, text_col), n)
        ids, sizes = B.ids_of(table, id_col), np.diff(bounds)
        digests = [hashlib.blake2b(values[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(ids))]
        pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        size = len(ids)
        none = pa.nulls(size, pa.int64())
        yield {"kind": ["doc"] * size, "row": (batch << _ROW_BITS) + np.arange(size), "doc_id": ids, "n": sizes, "hi": pair[:, 0], "lo": pair[:, 1], "bucket": none, "batch": none, "blob": pa.nulls(size, pa.binary())}
        seen: dict[bytes, int] = {}
        first = np.array([seen.setdefault(d, i) == i for i, d in enumerate(digests)], bool) & (sizes > 0)
        keep = np.flatnonzero(first)
        own = np.concatenate([[0], np.cumsum(sizes[keep])])
        sig, doc, group, skips = partitions.signatures(values[K.spread(bounds[keep], sizes[keep])], own, num, den)
        for b, part in B.by_bucket(B.bucket_of(sig, buckets)):
            blob = (B.pack((sig[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()), B.pack((keep[doc[part]] * 2 + group[part]).astype(np.uint32).tobytes()), B.pack(skips[part].astype(np.uint32).tobytes()))
            head = np.array([len(x) for x in blob], np.int64).tobytes()
            yield {"kind": ["sig"], "row": [None], "doc_id": [None], "n": [None], "hi": [None], "lo": [None], "bucket": [b], "batch": [batch], "blob": [head + b"".join(blob)]}

    return run


def _read(blob: bytes) -> list[np.ndarray]:
    at, out = 24, []
    for n in np.frombuffer(blob[:24], np.int64):
        out.append(np.frombuffer(B.unpack(blob[at : at + n]), np.uint32).astype(np.int64))
        at += n
    return out


def _shared(hot: int):
    def run(table: pa.Table):
        bucket = table.column("bucket")[0].as_py()
        low, who, skips, batch = [], [], [], []
        for b, blob in zip(table.column("batch").to_pylist(), table.column("blob")):
            x, y, z = _read(blob.as_py())
            low.append(x), who.append(y), skips.append(z), batch.append(np.full(len(x), b))
        low, who, skips, batch = map(np.concatenate, (low, who, skips, batch))
        _, inverse, counts = np.unique(low, return_inverse=True, return_counts=True)
        counts = counts[inverse]
        keep = counts > 1
        row = (batch[keep] << _ROW_BITS) + (who[keep] >> 1)
        yield {"sig": (bucket << 32) + low[keep], "row": row, "band": who[keep] & 1, "hot": (counts[keep] > hot).astype(np.int64), "skips": skips[keep]}

    return run


def _sets(text_col: str, n: int):
    def run(batch: int, table: pa.Table, wanted: pa.Table):
        at = np.unique(wanted.column("row").to_numpy() & ((1 << _ROW_BITS) - 1))
        if not len(at):
            return
        texts = table.column(text_col).cast(pa.binary()).take(pa.array(at))
        values, bounds = words.shingle_sets([x or b"" for x in texts.to_pylist()], n)
        yield {"row": (batch << _ROW_BITS) + at, "tokens": pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))}

    return run


def _sketches(text_col: str, n: int):
    """Cells of 4 bits, two a byte: sums of tokens' hashes; as many cells as half the tokens, up to a power of two."""

    def run(batch: int, table: pa.Table, wanted: pa.Table):
        at = np.unique(wanted.column("row").to_numpy() & ((1 << _ROW_BITS) - 1))
        if not len(at):
            return
        texts = table.column(text_col).cast(pa.binary()).take(pa.array(at))
        values, bounds = words.shingle_sets([x or b"" for x in texts.to_pylist()], n)
        out = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            h = K.mix(values[i:j])
            cells = 1 << max(6, ((j - i) // 2).bit_length())
            cell = np.bincount((h % np.uint64(cells)).astype(np.int64), (h >> np.uint64(60)).astype(float), cells).astype(np.int64) & 15
            out.append((cell[::2] * 16 + cell[1::2]).astype(np.uint8).tobytes())
        yield {"row": (batch << _ROW_BITS) + at, "n": np.diff(bounds), "sketch": pa.array(out, pa.binary())}

    return run


def fold(sketch: bytes, cells: int) -> np.ndarray:
    """A sketch with fewer cells: those that fall together are added."""
    raw = np.frombuffer(sketch, np.uint8)
    cell = np.empty(2 * len(raw), np.uint8)
    cell[::2], cell[1::2] = raw >> 4, raw & 15
    return cell.reshape(-1, cells).sum(axis=0, dtype=np.uint8) & 15


def _most(num: int, den: int, sizes):
    """Largest symmetric difference of two sets that link, by the sum of their sizes."""
    return (den - num) * sizes // (den + num)


def _near(num: int, den: int):
    """Pairs that could link by the lower bound that their sketches give."""

    def run(it):
        for rows in it:
            keep = []
            for n, m, x, y in zip(*(rows.column(c).to_pylist() for c in ("n", "m", "x", "y"))):
                most, cells = _most(num, den, n + m), 2 * min(len(x), len(y))
                keep.append(abs(n - m) <= most and int(np.count_nonzero(fold(x, cells) != fold(y, cells))) <= most)
            yield rows.select(["b", "a"]).filter(pa.array(keep, pa.bool_()))

    return run


def _could_link(num: int, den: int, turn: int):
    """Pairs of a group that could link and that it is the ``turn`` of; a row without a pair if some are left for later turns."""

    def run(table: pa.Table) -> pa.Table:
        row, comp, now, size, block = (table.column(c).to_numpy() for c in ("row", "comp", "now", "n", "block"))
        key = [table.column(c)[0].as_py() for c in ("sig", "bi", "bj")]
        raw = table.column("sketch").to_pylist()
        cells = 2 * min(map(len, raw))
        cell = np.stack([fold(x, cells) for x in raw])
        a, b = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        e = np.empty(0, np.int64)
        found = [(e, e, e)]
        step = max(1, (8 << 20) // (cells * max(1, len(b))))
        for i in range(0, len(a), step):
            x = a[i : i + step]
            most = _most(num, den, size[x][:, None] + size[b][None, :])
            ok = (comp[x][:, None] != comp[b][None, :]) & (np.abs(size[x][:, None] - size[b][None, :]) <= most)
            if key[1] == key[2]:
                ok &= row[x][:, None] < row[b][None, :]
            if ok.any():
                differ = (cell[x][:, None, :] != cell[b][None, :, :]).sum(axis=2)
                p, q = np.nonzero(ok & (differ <= most))
                found.append((x[p], b[q], differ[p, q]))
        p, q, differ = (np.concatenate(x) for x in zip(*found))
        # A pair that shares a smaller signature is left to that one's group.
        low = np.full((len(row), KNOWN), -1, np.int64)
        for i, values in enumerate(table.column("low").to_pylist()):
            low[i, : len(values)] = values
        low[low >= key[0]] = -1
        mine = np.ones(len(p), bool)
        for i in range(0, len(p), 1 << 14):
            x, y = low[p[i : i + (1 << 14)]], low[q[i : i + (1 << 14)]]
            mine[i : i + (1 << 14)] = ~((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).any(axis=(1, 2))
        p, q, differ = p[mine], q[mine], differ[mine]
        # The order is the same in every turn: by rank among the pairs of two components, as they are before the first.
        low, high = np.minimum(comp[p], comp[q]), np.maximum(comp[p], comp[q])
        order = np.lexsort((row[q], row[p], differ, high, low))
        new = np.ones(len(order), bool)
        new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        head = np.flatnonzero(new)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
        order = np.lexsort((row[q], row[p], differ, rank))
        end = lambda t: 0 if t < 0 else min(len(raw) * 8**t, int(np.count_nonzero(rank < 8**t)))
        some = order[end(turn - 1) : end(turn)]
        some = some[now[p[some]] != now[q[some]]]
        later = order[end(turn) :]
        rest = [None] if (now[p[later]] != now[q[later]]).any() else []
        p, q = row[p[some]], row[q[some]]
        keys = [[k] * (len(p) + len(rest)) for k in key]
        return pa.table({"a": pa.array([*np.minimum(p, q), *rest], pa.int64()), "b": pa.array([*np.maximum(p, q), *rest], pa.int64()), "sig": pa.array(keys[0], pa.int64()), "bi": pa.array(keys[1], pa.int64()), "bj": pa.array(keys[2], pa.int64())})

    return run


class JaccardJoin:
    """Links of documents whose sets of ``n``-word shingles have a Jaccard similarity of num/den or more."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, hot: int = HOT, **sizes):
        self.ws = ws = Workspace(df.sparkSession, "jaccard")
        self.batches = batches = B.Batches(df, text_col, ws, **sizes)
        self.columns = df.schema
        self.num, self.den = num, den
        first = ws.write("first", batches.ask(_first(id_col, text_col, n, num, den, batches.buckets), _FIRST), "kind")
        self.docs = first.where("kind = 'doc'").select("row", "doc_id", "n", "hi", "lo")
        shared = B.answer(first.where("kind = 'sig'").select("bucket", "batch", "blob"), _shared(hot), "sig long, row long, band long, hot long, skips long")
        self.nodes = self.docs.where("n > 0").groupBy("hi", "lo").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
        kept = shared.join(self.nodes.select(F.col("node").alias("row")), "row", "left_semi")
        n_hot = F.sum("hot").over(Window.partitionBy("row", "band"))
        kept = kept.withColumn("n_hot", n_hot).where("hot = 0 or n_hot > skips").select("sig", "row").distinct()
        # What copies alone share is one node's by now and goes; of the rest each row has its star's centre.
        star = Window.partitionBy("sig")
        kept = kept.withColumn("a", F.min("row").over(star)).withColumn("c", F.count("*").over(star)).where("c > 1")
        self.sigs = sigs = ws.write("sigs", kept)
        pairs = ws.write("pairs", sigs.where("a <> row").select("a", F.col("row").alias("b")).distinct())
        wanted = sigs.select("row").distinct().withColumn("batch", F.shiftright("row", _ROW_BITS))
        self.sketches = ws.write("sketches", batches.give(wanted, _sketches(text_col, n), "row long, n long, sketch binary"))
        self._read_sets = _sets(text_col, n)
        links = self._verified(ws.write("near", self._possible(pairs)), "links")
        base = labels = components(links, ws, "parts")
        groups, behind = None, False
        for turn in itertools.count():
            found = ws.write(f"across_{turn}", self._across(base, labels, groups, turn))
            more = self._verified(found.where("a is not null").select("a", "b").distinct(), f"more_{turn}")
            links, behind = links.union(more), behind or not more.isEmpty()
            groups = found.where("a is null").select("sig", "bi", "bj")
            if groups.isEmpty():
                break
            if behind:
                labels, behind = components(links, ws, f"all_{turn}"), False
        if behind:
            labels = components(links, ws, "all")
        self.links, self.labels = links, labels

    def _possible(self, pairs: DataFrame) -> DataFrame:
        x = self.sketches.select(F.col("row").alias("a"), "n", F.col("sketch").alias("x"))
        y = self.sketches.select(F.col("row").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
        return pairs.join(x, "a").join(y, "b").mapInArrow(_near(self.num, self.den), "b long, a long").select("a", "b")

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        rows = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct().withColumn("batch", F.shiftright("row", _ROW_BITS))
        sets = self.ws.write(f"{name}_sets", self.batches.give(rows, self._read_sets, "row long, tokens array<long>"))
        x = sets.select(F.col("row").alias("a"), F.col("tokens").alias("x"))
        y = sets.select(F.col("row").alias("b"), F.col("tokens").alias("y"))
        both = pairs.join(x, "a").join(y, "b")
        meet = F.size(F.array_intersect("x", "y")).cast("long")
        both = both.select("a", "b", meet.alias("i"), (F.size("x") + F.size("y")).cast("long").alias("s"))
        found = both.where(F.col("i") * self.den >= (F.col("s") - F.col("i")) * self.num).select("a", "b")
        return self.ws.write(name, found)

    def _across(self, base: DataFrame, labels: DataFrame, groups: DataFrame | None, turn: int) -> DataFrame:
        """Pairs to verify, of the groups (signature and two blocks) that have some left; ``base`` are the first turn's components."""
        root = lambda x, name: x.select(F.col("node").alias("row"), F.col("root").alias(name))
        if turn == 0:
            group = Window.partitionBy("sig")
            rows = self.sigs.where("c > 2").join(root(base, "comp"), "row", "left").select("sig", "row", F.coalesce("comp", "row").alias("comp"), F.expr(f"(c + {BLOCK - 1}) div {BLOCK}").alias("nb"))
            rows = rows.withColumn("x", F.min("comp").over(group)).withColumn("y", F.max("comp").over(group)).where("x <> y")
            self.mixed = self.ws.write("mixed", rows.select("sig", "row", "comp", "nb"))
            held = self.mixed.groupBy("row").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, KNOWN).alias("low"))
            self.low = self.ws.write("low", held.join(self.sketches, "row"))
        rows = self.mixed if groups is None else self.mixed.join(groups.select("sig").distinct(), "sig", "left_semi")
        rows = rows.withColumn("block", F.expr("pmod(xxhash64(row), nb)"))
        rows = rows.join(root(labels, "now"), "row", "left").withColumn("now", F.coalesce("now", "row")) if turn else rows.withColumn("now", F.col("comp"))
        rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, nb - 1)"))).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
        if groups is not None:
            rows = rows.join(groups, ["sig", "bi", "bj"], "left_semi")
        rows = rows.join(self.low, "row").select("sig", "bi", "bj", "row", "comp", "now", "n", "sketch", "block", "low")
        return rows.groupBy("sig", "bi", "bj").applyInArrow(_could_link(self.num, self.den, turn), "a long, b long, sig long, bi long, bj long")

    def rows(self) -> DataFrame:
        """(row, doc_id, n_shingles, component_id, root) of every row of the input."""
        docs = self.docs.join(self.nodes, ["hi", "lo"], "left").join(self.labels, "node", "left")
        docs = docs.select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node", "row").alias("root"), "least")
        least = self.nodes.join(self.labels, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("component"))
        out = docs.join(least, "root", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
        null = lambda c: F.when(F.col(c) != B.NO_ID, F.col(c)).alias(c)
        return out.select("row", null("doc_id"), "n_shingles", null("component_id"), "root")

    def kept(self) -> DataFrame:
        """The rows of the input, whole, with one document of each component: the smallest doc_id."""
        rows = self.rows()
        first = rows.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(B.NO_ID)), "row")).alias("k")).select(F.col("k.row").alias("row"))
        chosen = first.withColumn("batch", F.shiftright("row", _ROW_BITS))
        names = self.columns.names

        def run(batch, table, answers):
            at = np.sort(answers.column("row").to_numpy() & ((1 << _ROW_BITS) - 1))
            yield {c: table.column(c).take(pa.array(at)).combine_chunks() for c in names}

        return self.batches.give(chosen, run, ddl(self.columns))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return JaccardJoin(docs, n=3, num=90, den=100).rows().select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(words, i, i + 2) AS k
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, CASE WHEN len(words) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(r.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a) r USING (doc_id)
"""
