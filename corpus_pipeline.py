"""A pipeline of training-data stages over the table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basepack.llm import decontam, jaccard, langid, packing, suffix_dedup
from basepack.workspace import Workspace

_used: list[Workspace] = []


def _released(ws: Workspace | None = None) -> None:
    """Deletes the working tables of earlier stages, whose results are written, and keeps ``ws`` in mind."""
    while _used:
        _used.pop().close()
    if ws:
        _used.append(ws)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay; those without a letter, null texts included, go.

    A document without a lang gets the one predicted.  Ties between languages go to the smaller
    name.  Where nothing was learned, and in an empty table, nothing stays.
    """
    held_out = langid.fold("doc_id") % langid.FOLDS == langid.HELD_OUT
    learned = langid.profiles(docs.where(~held_out), "text", "lang")
    lang = F.coalesce(F.col("lang").cast("string"), F.col("lang_pred")).cast(docs.schema["lang"].dataType).alias("lang")
    return langid.predict(docs, learned).where("lang_pred <> 'und'").select(*(lang if c == "lang" else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of a 5-word-shingle similarity of 0.8 or more stays, that of the smallest doc_id.

    A null doc_id counts as larger than all others; of rows with equal doc_id in a group one stays.
    Documents without words are no group and stay.
    """
    _released()
    join = jaccard.JaccardJoin(docs, n=5, num=80, den=100)
    _released(join.ws)
    return join.kept()


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes go where a document of a smaller doc_id has them; n_chars follows the text.

    Null texts stay null, rows with equal doc_id never cut one another, and every row stays, emptied ones too.
    """
    _released()
    found = suffix_dedup.repeats(docs)
    _released(found.ws)
    kept = suffix_dedup.dedup(found)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row judged for itself; null texts and an empty benchmark hold none."""
    _released()
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids; a null text is its end token alone."""
    return packing.pack(docs, ids=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packed", packed),
]

#: No SQL: rank-order profiles, suffix arrays and alignments are beyond it; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.write(name, stage(spark, docs, sf_dir))
    return docs
