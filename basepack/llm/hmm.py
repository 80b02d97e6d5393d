"""Hidden Markov language model: Baum-Welch over all learning documents, exact scaled likelihood.

A latent state emits a word's class (a hash of its last letters), the class emits the word.  Words'
counts are asked for in buckets of their hashes, once a batch, so a frequent word is no hot key.
Baum-Welch runs over all learning documents, whole: each task adds up the expected counts of its
batches, and their sums over the tasks give the next parameters, whose size is fixed.  Texts run side
by side; a text of more than CHUNK tokens runs as several lanes at once, which share the tokens at
their borders: the product of a lane's transitions carries what is known of the text before and
behind it over the border, so nothing is lost there.  Sums are in single precision within a batch.  A
text's score is the scaled forward recursion over its whole length, in double precision:

    log10 P(text) = sum over tokens of log10 P(word | class) + log10 sum over paths P(classes, states)

P(word | class) adds one to each count, and to one unknown word of each class.

Null and empty texts are the end token alone.  A null doc_id is not held out.  Rows that repeat a
doc_id are texts of their own, learned from and scored one by one.  Words are told apart by 64-bit
hashes.  When nothing was learned, all words are unknown.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import batches as B
from . import caches
from . import kernels as K
from . import words as W

STATES = 8
CLASSES = 4096
ROUNDS = 4
SUFFIX = 3
#: Tokens of a lane of Baum-Welch.
CHUNK = 1024
#: Pseudo-counts, dealt like all words' classes, that each state's emissions get.
PRIOR = 50.0
FOLDS, HELD_OUT = 7, 2
_END = 0xE4D


def word_class(word: bytes) -> int:
    """Class 0 is the end token's."""
    return 1 + xxhash.xxh3_64_intdigest(word.decode("utf-8", "replace")[-SUFFIX:].encode()) % (CLASSES - 1)


class _Classes(dict):
    """Classes of words seen; an accelerator only."""

    def __missing__(self, word: bytes) -> int:
        self[word] = c = word_class(word)
        return c


class _Numbers(dict):
    """Words of a batch, numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_classes = caches.register("words", _Classes())
_MOST = caches.entries()


def _with_ends(values: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values and, after them, its end token's; and the new bounds."""
    ends = bounds[1:] + np.arange(len(bounds) - 1)
    out = np.empty(len(values) + len(ends), np.int64)
    out[ends] = end
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = values
    return out, np.concatenate([[0], ends + 1])


def read(table: pa.Table, text_col: str):
    """(distinct word hashes, their classes, word number of each token, bounds of the texts)."""
    caches.bound(_classes, _MOST)
    found, bounds = W.split([t.lower() for t in B.texts_of(table, text_col)])
    number = _Numbers()
    token = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
    keys = np.concatenate([W.hashes(list(number)), np.array([_END], np.uint64)])
    classes = np.array([*map(_classes.__getitem__, number), 0], np.int64)
    return keys, classes, *_with_ends(token, bounds, len(number))


def learns(table: pa.Table) -> np.ndarray:
    return ~table.column("held_out").to_numpy()


def _ask(text_col: str, buckets: int):
    def run(batch, table):
        keys, classes, token, bounds = read(table, text_col)
        each = np.repeat(learns(table), np.diff(bounds))
        counts = np.bincount(token[each], minlength=len(keys))
        for b, part in B.by_bucket(B.bucket_of(keys, buckets)):
            arrays = [keys[part].tobytes(), counts[part].astype(np.int32).tobytes(), classes[part].astype(np.int16).tobytes()]
            yield {"kind": ["words"], "bucket": [b], "batch": [batch], "blob": [B.pack(len(part).to_bytes(8, "little") + b"".join(arrays))]}
        # What Baum-Welch reads in each round: the classes of the learning texts.
        n = np.diff(bounds)[learns(table)]
        blob = len(n).to_bytes(8, "little") + n.tobytes() + classes[token[each]].astype(np.int16).tobytes()
        yield {"kind": ["texts"], "bucket": [None], "batch": [batch], "blob": [B.pack(blob)]}

    return run


def _count(table: pa.Table):
    """Counts of a bucket's words, for each batch; and words and tokens of each class."""
    parts = []
    for blob in table.column("blob").to_pylist():
        raw = B.unpack(blob)
        n = int.from_bytes(raw[:8], "little")
        parts.append((np.frombuffer(raw, np.uint64, n, 8), np.frombuffer(raw, np.int32, n, 8 + 8 * n), np.frombuffer(raw, np.int16, n, 8 + 12 * n)))
    keys, counts, classes = (np.concatenate(x) for x in zip(*parts))
    values, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(inverse, counts).astype(np.int64)
    for batch, bucket, part in zip(table.column("batch").to_pylist(), table.column("bucket").to_pylist(), parts):
        answer = total[np.searchsorted(values, part[0])]
        yield {"kind": ["count"], "batch": [batch], "bucket": [bucket], "blob": [B.pack(answer.tobytes())], "class": [None], "n": [None], "v": [None]}
    known = total > 0
    cls = classes[first][known].astype(np.int64)
    n, v = np.bincount(cls, total[known], minlength=CLASSES).astype(np.int64), np.bincount(cls, minlength=CLASSES)
    some = np.flatnonzero(v)
    none = pa.nulls(len(some), pa.int64())
    yield {"kind": ["class"] * len(some), "batch": none, "bucket": none, "blob": pa.nulls(len(some), pa.binary()), "class": some, "n": n[some], "v": v[some]}


class Parameters:
    """first: states; step: states x states; emit: classes x states."""

    def __init__(self, first: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.first, self.step, self.emit = first, step, emit

    @staticmethod
    def initial(tokens: np.ndarray, states: int) -> Parameters:
        """Sticky states; each class leans to one state, by a fixed hash."""
        share = (tokens + 1) / (tokens.sum() + len(tokens))
        lean = np.ones((len(tokens), states))
        lean[np.arange(len(tokens)), (K.mix(np.arange(len(tokens), dtype=np.uint64)) % np.uint64(states)).astype(np.int64)] = 4
        emit = lean * share[:, None]
        step = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
        return Parameters(np.full(states, 1 / states), step, emit / emit.sum(axis=0))

    @staticmethod
    def from_counts(first: np.ndarray, step: np.ndarray, emit: np.ndarray, tokens: np.ndarray) -> Parameters:
        share = (tokens + 1) / (tokens.sum() + len(tokens))
        first, step, emit = first + 1, step + 1, emit + PRIOR * share[:, None]
        return Parameters(first / first.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _by_time(classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Classes of sequences sorted by falling length, all first tokens, then all second ones; and where each time begins."""
    alive = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    cut = np.concatenate([[0], np.cumsum(alive)])
    lane = K.spread(np.zeros(len(alive), np.int64), alive)
    return classes[starts[lane] + np.repeat(np.arange(len(alive)), alive)], cut


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _transfers(classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, p: Parameters) -> np.ndarray:
    """For each lane the product of step and emission over its tokens after the first, up to a factor."""
    order = np.argsort(-lengths, kind="stable")
    seen, cut = _by_time(classes, starts[order], lengths[order])
    n = len(p.first)
    out = np.broadcast_to(np.eye(n, dtype=np.float32), (len(order), n, n)).copy()
    step, emit = p.step.astype(np.float32), p.emit.astype(np.float32)
    for t in range(1, len(cut) - 1):
        i, j = cut[t], cut[t + 1]
        x = (out[: j - i].reshape(-1, n) @ step).reshape(-1, n, n) * emit[seen[i:j]][:, None, :]
        out[: j - i] = x / x.sum(axis=(1, 2), keepdims=True)
    back = np.empty_like(out)
    back[order] = out
    return back


def _lanes(classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, p: Parameters, chunk: int):
    """(start, length, inner, alpha at the first token, beta at the last) of the lanes of some texts.

    Lanes of a text share the tokens at their borders; ``inner`` lanes start at one.
    """
    many = np.maximum(1, -(-(lengths - 1) // chunk))
    text = np.repeat(np.arange(len(many)), many)
    number = K.spread(np.zeros(len(many), np.int64), many)
    at = starts[text] + chunk * number
    size = np.minimum(chunk + 1, starts[text] + lengths[text] - at)
    alpha = _unit(p.first * p.emit[classes[at]])
    beta = np.ones((len(at), len(p.first)))
    long = np.flatnonzero(many[text] > 1)
    if len(long):
        product = np.zeros((len(at), len(p.first), len(p.first)))
        product[long] = _transfers(classes, at[long], size[long], p)
        for k in range(1, int(many.max())):
            lane = np.flatnonzero(number == k)
            alpha[lane] = _unit(np.einsum("ls,lst->lt", alpha[lane - 1], product[lane - 1]))
        left = many[text] - number
        for k in range(2, int(many.max()) + 1):
            lane = np.flatnonzero(left == k)
            beta[lane] = _unit(np.einsum("lst,lt->ls", product[lane + 1], beta[lane + 1]))
    return at, size, number > 0, alpha, beta


def expected(classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, p: Parameters, chunk: int = CHUNK):
    """Expected counts (first, step, emit) of the texts classes[start:start + length].

    In single precision: every state and step is scaled to sum to 1.
    """
    n_states = len(p.first)
    first, step, emit = np.zeros(n_states), np.zeros((n_states, n_states)), np.zeros((len(p.emit), n_states))
    if not len(lengths):
        return first, step, emit
    at, size, inner, alpha_in, beta_out = _lanes(classes, starts, lengths, p, chunk)
    order = np.argsort(-size, kind="stable")
    size, inner, alpha_in, beta_out = size[order], inner[order], alpha_in[order].astype(np.float32), beta_out[order].astype(np.float32)
    seen, cut = _by_time(classes, at[order], size)
    out = p.emit.astype(np.float32)[seen]
    step32, ones = p.step.astype(np.float32), np.ones(n_states, np.float32)
    alpha, scale = np.empty_like(out), np.empty((len(seen), 1), np.float32)
    alpha[: cut[1]], scale[: cut[1]] = alpha_in, 1
    for t in range(1, len(cut) - 1):
        i, j = cut[t], cut[t + 1]
        a, s = alpha[i:j], scale[i:j]
        np.matmul(alpha[cut[t - 1] : cut[t - 1] + j - i], step32, out=a)
        a *= out[i:j]
        s[:, 0] = a @ ones
        a /= s
    # Lanes that end at time t enter the backward pass with their beta, scaled so that alpha * beta sums to 1.
    beta = np.ones((0, n_states), np.float32)
    for t in range(len(cut) - 2, -1, -1):
        i, j = cut[t], cut[t + 1]
        if j - i > len(beta):
            new = beta_out[len(beta) : j - i]
            beta = np.concatenate([beta, new / (alpha[i + len(beta) : j] * new).sum(axis=1, keepdims=True)])
        if t:
            ahead = out[i:j]
            ahead *= beta
            ahead /= scale[i:j]
            before = cut[t - 1]
            step += alpha[before : before + j - i].T @ ahead
        alpha[i:j] *= beta
        if t:
            beta = ahead @ step32.T
    first += alpha[: cut[1]][~inner].sum(axis=0)
    alpha[: cut[1]][inner] = 0  # counted by the lane before, whose last token it is
    for s in range(n_states):
        emit[:, s] = np.bincount(seen, alpha[:, s], minlength=len(p.emit))
    return first, step * p.step, emit


def log_likelihoods(classes: np.ndarray, bounds: np.ndarray, p: Parameters) -> np.ndarray:
    """log10 of each text's probability of its classes: the scaled forward recursion, texts side by side."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    seen, cut = _by_time(classes, bounds[:-1][order], lengths[order])
    scale, ones, a = np.empty(len(seen)), np.ones(len(p.first)), None
    for t in range(len(cut) - 1):
        i, j = cut[t], cut[t + 1]
        a = (np.broadcast_to(p.first, (j - i, len(p.first))) if t == 0 else a[: j - i] @ p.step) * p.emit[seen[i:j]]
        scale[i:j] = s = a @ ones
        a /= s[:, None]
    lane = K.spread(np.zeros(len(cut) - 1, np.int64), np.diff(cut))
    back = np.empty(len(order))
    back[order] = np.bincount(lane, np.log10(scale), minlength=len(order))
    return back


class Model:
    def __init__(self, df: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, **sizes):
        """Learns from the rows for which the column ``held_out`` isn't true."""
        ws = Workspace(df.sparkSession, "hmm")
        self.text_col = text_col
        rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), F.coalesce(held_out, F.lit(False)).alias("held_out"))
        self.batches = batches = B.Batches(rows, text_col, ws, **sizes)
        first = ws.write("first", batches.ask(_ask(text_col, batches.buckets), "kind string, bucket long, batch long, blob binary"), "kind")
        self.texts = first.where("kind = 'texts'").select("blob")
        asked = first.where("kind = 'words'").select("bucket", "batch", "blob")
        answers = ws.write("counts", B.answer(asked, _count, "kind string, batch long, bucket long, blob binary, class long, n long, v long"), "kind")
        self.counts = answers.where("kind = 'count'").select("batch", "bucket", "blob")
        self.tokens, self.vocabulary = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for r in answers.where("kind = 'class'").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # CLASSES rows at most
            self.tokens[r["class"]], self.vocabulary[r["class"]] = r.n, r.v
        self.parameters = Parameters.initial(self.tokens, states)
        for _ in range(rounds):
            self.parameters = self._round(states)

    def _round(self, states: int) -> Parameters:
        p = self.parameters

        def run(it):
            first, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states))
            for rows in it:
                for blob in rows.column("blob"):
                    raw = B.unpack(blob.as_py())
                    m = int.from_bytes(raw[:8], "little")
                    n, classes = np.frombuffer(raw, np.int64, m, 8), np.frombuffer(raw[8 + 8 * m :], np.int16)
                    for x, y in zip((first, step, emit), expected(classes, np.cumsum(n) - n, n, p)):
                        x += y
            some = np.flatnonzero(emit.any(axis=1))
            values = np.concatenate([first[None], step, emit[some]])
            kind = np.concatenate([[-1], np.full(states, -2) - np.arange(states), some])
            yield pa.RecordBatch.from_pydict({"kind": kind, "x": pa.array(list(values), pa.list_(pa.float64()))})

        sums = self.texts.mapInArrow(run, "kind long, x array<double>")
        total = sums.groupBy("kind").agg(*(F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(states)))
        first, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states))
        for r in total.collect():  # CLASSES + states + 1 rows at most
            x = np.array(r[1:], float)
            if r.kind == -1:
                first = x
            elif r.kind < -1:
                step[-2 - r.kind] = x
            else:
                emit[r.kind] = x
        return Parameters.from_counts(first, step, emit, self.tokens)

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
        text_col, p, tokens, vocabulary = self.text_col, self.parameters, self.tokens, self.vocabulary
        total, distinct = int(tokens.sum()), int(vocabulary.sum())

        def run(batch, table, answers):
            keys, classes, token, bounds = read(table, text_col)
            count = np.zeros(len(keys), np.int64)
            place = [part for _, part in B.by_bucket(B.bucket_of(keys, buckets))]
            order = np.argsort(answers.column("bucket").to_numpy())
            blobs = answers.column("blob").to_pylist()
            for part, i in zip(place, order, strict=True):
                count[part] = np.frombuffer(B.unpack(blobs[i]), np.int64)
            base = np.log10(count + 1.0) - math.log10(total + distinct + 1)
            within = np.log10((count + 1.0) / (tokens[classes] + vocabulary[classes] + 1))
            add = lambda x: np.add.reduceat(x[token], bounds[:-1]) if len(bounds) > 1 else np.empty(0)  # noqa: E731  no text is without its end
            yield {"doc_id": table.column("doc_id").combine_chunks(), "held_out": table.column("held_out").combine_chunks(), "n_tokens": np.diff(bounds), "n_known": add((count > 0).astype(np.int64)), "train_tokens": np.full(len(bounds) - 1, total), "base_score": add(base), "score": add(within) + log_likelihoods(classes[token], bounds, p)}

        buckets = self.batches.buckets
        return self.batches.give(self.counts, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_hmm_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    return Model(docs, held_out).scores()
