"""Quality rules: a ledger of measurements and failure bits, and versioned policies over it.

Native.  Each rule is evaluated once; its failure sets a bit.  A policy is a mask of rules: a
document is kept if none of them failed, so new policies and ablations read bits, not texts.

Null texts and texts without words measure 0 everywhere and fail the rule on length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .url_filter import let

_SPACE = r"[\x20\x09-\x0D]"
_SPACES = " \t\n\x0b\x0c\r"

#: Rules in the order of their bits: when a document fails, by its measurements.
RULES = (
    ("short", "n_words < 50"),
    ("repeated", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("same_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "10 * word_chars < 25 * n_words OR word_chars > 12 * n_words"),
    ("capitals", "10 * n_capitals > 3 * word_chars"),
    ("exclamations", "2 * n_marks > n_words"),
)
#: Versioned policies: names of rules.
POLICIES = {"base": ("short", "repeated"), "v1": tuple(name for name, _ in RULES)}


def mask(policy: str) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in POLICIES[policy])


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more.  Windows are told apart by 64-bit hashes."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("t"), i.alias("i")))

    def starts(s: Column) -> Column:
        twice = F.transform(s, lambda x, k: F.when((x["t"] == F.get(s, k - 1)["t"]) | (x["t"] == F.get(s, k + 1)["t"]), x["i"]))
        return F.sort_array(F.filter(twice, lambda x: x.isNotNull()))

    def cover(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    found = let(hashed, lambda h: let(F.array_sort(windows(h)), lambda s: let(starts(s), cover)))
    return F.when(F.size(words) >= 3, found).otherwise(F.lit(0)).cast("long")


def ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with measurements and ``fail_bits``; columns of these names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, _SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _SPACES, "") != "")
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = df.withColumns({"w__": by_words, "l__": by_lines, "word_chars": F.length(F.translate(text, _SPACES, "")).cast("long"), "n_symbols": _count(text, "#*$%&|<>"), "n_capitals": _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_marks": _count(text, "!")})
    rows = rows.withColumns({"n_words": F.col("w__.n_words"), "n_repeat_words": F.col("w__.n_repeat_words"), "n_lines": F.col("l__.n_lines"), "n_dup_lines": F.col("l__.n_dup_lines")}).drop("w__", "l__")
    bits = F.lit(0)
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)))
    return rows.withColumn("fail_bits", bits)


def kept(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that stay without it.

    One aggregation over the distinct bit patterns, of which there are 2^rules at most.
    """
    m = mask(policy)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << i).alias("bit")) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]))
    each = patterns.withColumn("r", F.explode(rules))
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0))).alias(name)
    return each.groupBy("r.rule").agg(total(has, "n_failed"), total(F.col("bits") == F.col("r.bit"), "n_failed_alone"), total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, "n_kept_without"))


def op6_quality_rule_ledger(spark, sf_dir: str) -> DataFrame:
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    failed = (F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0).alias("base_failed")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed, kept("v1").alias("kept"), F.col("fail_bits").cast("long").alias("fail_bits"))


_FAILS = " | ".join(f"(CASE WHEN {fails} THEN {1 << i} ELSE 0 END)" for i, (_, fails) in enumerate(RULES))
SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
t AS (
  SELECT doc_id, i, list_slice(words, i, i + 2) AS t
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
twice AS (
  SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
         length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_marks
  FROM w LEFT JOIN repeats USING (doc_id)),
f AS (SELECT *, ({_FAILS})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & {mask("base")} <> 0 AS base_failed, fail_bits & {mask("v1")} = 0 AS kept, fail_bits
FROM f
"""
