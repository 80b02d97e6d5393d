import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("batch", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang", T.StringType())])


@pytest.fixture
def frame(spark):
    """Documents with columns whose names clash with those that operators use."""

    def make(rows):
        return spark.createDataFrame([(i, t, "b", 0.5, "en") for i, t in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture
def docs():
    """Copies, near copies, shared passages, and the awkward: null, empty, blank, ties, one long text."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, base = text(40), text(120).split()
    rows = [(0, " ".join(base)), (1, " ".join(base))]
    for i in range(2, 12):
        w = list(base)
        w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, f"{text(rng.randint(1, 40))} {shared} {text(rng.randint(1, 40))}") for i in range(12, 30)]
    rows += [(30, None), (31, ""), (32, " \t\n"), (33, "one"), (34, "One"), (35, "é" * 60 + " x"), (36, "é" * 60 + " x"), (37, f"{shared} {shared}")]
    rows += [(40, text(9000)), (41, "a b c d " * 3000), (42, "ab　cd\x1cef\x85gh " * 30)]
    return rows
