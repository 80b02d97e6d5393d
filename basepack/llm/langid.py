"""Language identification by rank-order profiles of character n-grams.

A language's profile ranks its most frequent n-grams over all its learning documents.  A document's
profile ranks its own; its distance from a language sums how far each of its n-grams is out of
place there (an n-gram that the language's profile lacks counts as the profile's length).  The
nearest language wins; ties go to the smaller name, n-grams of equal counts to the smaller code.

Texts are read whole, in pieces of PIECE characters, and their counts are added up piece by piece; so
memory follows the distinct n-grams, not the texts.

Null texts and texts without a letter are ``und``; so is every text when nothing was learned.  A
null doc_id is not held out.  Only text and lang of learning documents are used.  Rows that repeat a
doc_id, or whole rows, are judged one by one.  An empty table gives no rows.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace, ship
from . import caches
from .names import ddl, unused

TOP = 400
ORDERS = 3
FOLDS, HELD_OUT = 4, 2
#: Most entries of all profiles together that are sent to every task; beyond, profiles are joined.
MOST_SENT = 1_000_000
#: Characters whose n-grams are counted at once.
PIECE = 1 << 18
#: Distinct n-grams that a task holds before it gives them out.
HELD = 1 << 19
_TAG = (1 << 21) - 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letters(text: str) -> np.ndarray:
    """The lower-cased text; what is no letter is a blank (0), blanks run together, and one stands at each end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.concatenate([np.zeros(1, np.uint32), np.where(_letters()[c], c, np.uint32(0)), np.zeros(1, np.uint32)])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    return c[keep]


def grams(c: np.ndarray, first: int = 0, last: int | None = None, orders: int = ORDERS) -> np.ndarray:
    """Codes of the n-grams of 1 to 3 characters of ``letters`` that start at first to last - 1."""
    last = len(c) if last is None else last
    c = c[first : last + 2].astype(np.uint64)
    one, n = c[: last - first], last - first
    out = [one[one != 0] | np.uint64(_TAG << 42)]
    if orders > 1:
        out.append(((c[:-1] << np.uint64(21)) | c[1:] | np.uint64((_TAG - 1) << 42))[:n])
    if orders > 2 and len(c) > 2:
        out.append(((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[:n])
    return np.concatenate(out)


def added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of several (codes, counts)."""
    if len(counts) == 1:
        return counts[0]
    codes, inverse = np.unique(np.concatenate([c for c, _ in counts]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([n for _, n in counts]), len(codes)).astype(np.int64)


def counted(texts: list[np.ndarray], orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of some texts' ``letters``."""
    total, held, size = (np.empty(0, np.uint64), np.empty(0, np.int64)), [], 0
    for c in texts:
        for i in range(0, len(c), PIECE):
            held.append(grams(c, i, min(i + PIECE, len(c)), orders))
            size += len(held[-1])
            if size >= 3 * PIECE:
                total, held, size = added([total, np.unique(np.concatenate(held), return_counts=True)]), [], 0
    return added([total, np.unique(np.concatenate(held), return_counts=True)]) if held else total


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].any())


def profile(c: np.ndarray, top: int) -> np.ndarray:
    """Codes of the most frequent n-grams of ``letters``, most frequent first."""
    codes, counts = counted([c])
    return codes[np.lexsort((codes, -counts))[:top]]


def fold(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def profiles(df: DataFrame, text_col: str, lang_col: str, top: int = TOP) -> DataFrame:
    """(lang, gram, rank) of the ``top`` n-grams of each language, over all rows of ``df``."""
    ship(df.sparkSession)

    def count(it):
        caches.use("langid")
        held: dict[str, tuple] = {}

        def out():
            for lang, (codes, n) in held.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "gram": codes.view(np.int64), "n": n})
            held.clear()

        for rows in it:
            texts, langs = rows.column(0), rows.column(1)
            for i in range(0, len(texts), 256):
                by: dict[str, list] = {}
                for t, lang in zip(texts.slice(i, 256), langs.slice(i, 256).to_pylist()):
                    c = letters(t.as_py())
                    if c.any():
                        by.setdefault(lang, []).append(c)
                for lang, found in by.items():
                    now = counted(found)
                    held[lang] = added([held[lang], now]) if lang in held else now
                if sum(len(c) for c, _ in held.values()) > HELD:
                    yield from out()
        yield from out()

    counts = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, F.col(lang_col).cast("string")).mapInArrow(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    part = F.pmod(F.hash("gram"), F.lit(64))
    some = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("r") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1).where(F.col("rank") < top).select("lang", "gram", F.col("rank").cast("long"))


class Model:
    """Profiles as one table: a row for each n-gram of any profile, a column for each language."""

    def __init__(self, rows: list, top: int):
        self.top = top
        self.langs = sorted({r.lang for r in rows})
        column = {lang: i for i, lang in enumerate(self.langs)}
        self.codes = np.unique(np.array([r.gram for r in rows], np.int64).view(np.uint64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), top, np.int32)
        for r in rows:
            self.ranks[np.searchsorted(self.codes, np.array([r.gram], np.int64).view(np.uint64)[0]), column[r.lang]] = r.rank

    def predict(self, text: str | None) -> tuple[str, float]:
        c = letters(text or "")
        if not self.langs or not c.any():
            return "und", 0.0
        own = profile(c, self.top)
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        found = self.ranks[at]
        out = np.abs(found - np.arange(len(own))[:, None])
        out[found == self.top] = self.top
        far = out.sum(axis=0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.top * len(own)))


def predict(df: DataFrame, ranked: DataFrame, text_col: str = "text", top: int = TOP, most_sent: int = MOST_SENT) -> DataFrame:
    """The rows of ``df`` with lang_pred and score; columns of these names are replaced."""
    ws = Workspace(df.sparkSession, "langid")
    ranked = ws.write("profiles", ranked)
    df = df.drop("lang_pred", "score")
    if ranked.count() > most_sent:
        return _predict_joined(df, ranked, text_col, top, ws)
    model = Model(ranked.collect(), top)

    def run(it):
        caches.use("langid")
        for rows in it:
            for i in range(0, len(rows), 512):
                some = rows.slice(i, 512)
                found = [model.predict(t.as_py()) for t in some.column(some.schema.get_field_index(text_col))]
                more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*some.columns, *more], names=[*some.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, ddl(df.schema) + ", lang_pred string, score double")


def _predict_joined(df: DataFrame, ranked: DataFrame, text_col: str, top: int, ws: Workspace) -> DataFrame:
    """The same with profiles too large to send: documents' n-grams join them.

    Distances start from all n-grams missing, and a joined row takes back what it finds; so a
    language that shares none of a document's n-grams needs no row (unless none shares any).
    """
    own, row = unused(df, "own"), unused(df, "row")

    def profiled(it):
        caches.use("langid")
        for rows in it:
            for i in range(0, len(rows), 512):
                some = rows.slice(i, 512)
                found = (letters(t.as_py() or "") for t in some.column(some.schema.get_field_index(text_col)))
                out = [profile(c, top).view(np.int64) if c.any() else np.empty(0, np.int64) for c in found]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(out, pa.list_(pa.int64()))], names=[*some.schema.names, own])

    rows = ws.write("own", df.mapInArrow(profiled, f"{ddl(df.schema)}, `{own}` array<long>").withColumn(row, F.monotonically_increasing_id()))
    each = rows.select(F.col(row).alias("row"), F.size(own).alias("m"), F.posexplode(own).alias("r", "gram"))
    saved = F.sum(F.lit(top) - F.least(F.abs(F.col("r") - F.col("rank")), F.lit(top)))
    near = each.join(ranked, "gram").groupBy("row", "m", "lang").agg(saved.alias("saved"))
    best = near.groupBy(F.col("row").alias(row)).agg(F.min(F.struct((-F.col("saved")).alias("s"), "lang", "m")).alias(unused(df, "best")))
    least = F.lit(ranked.agg(F.min("lang")).first()[0]).cast("string")
    best_of = F.col(unused(df, "best"))
    none = (F.size(own) == 0) | least.isNull()
    lang = F.when(none, F.lit("und")).otherwise(F.coalesce(best_of["lang"], least))
    score = F.when(none, F.lit(0.0)).otherwise(F.coalesce(-best_of["s"] / (F.lit(top) * best_of["m"]), F.lit(0.0)))
    return rows.join(best, row, "left").select(*(F.col(f"`{c}`") for c in df.columns), lang.alias("lang_pred"), score.cast("double").alias("score"))


def op10_rank_order_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = (fold("doc_id") % FOLDS == HELD_OUT).alias("held_out")
    learned = profiles(docs.where(~held_out), "text", "lang")
    return predict(docs.select("doc_id", held_out, "text"), learned).select("doc_id", "held_out", "lang_pred", "score")
