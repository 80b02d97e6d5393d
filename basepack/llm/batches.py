"""Documents in batches, and questions that batches ask about keys.

A batch is one row that holds some megabytes of whole documents.  Kernels run over whole batches,
and a key that many documents share is asked for once a batch: that is the combine before each
shuffle, and it bounds what a hot key can send.  Keys go to buckets by their hash; a bucket's
questions meet in one group, whose size is bounded by the number of buckets, which follows the
bytes of text.  Answers go back to their batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import caches
from . import kernels as K

#: Bytes of text of a batch.  A longer document is a batch of its own.
BATCH_BYTES = 4 << 20
#: Bytes of text for each bucket of keys.
BUCKET_BYTES = 12 << 20
NO_ID = np.iinfo(np.int64).max


def pack(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def unpack(data: bytes) -> bytes:
    return zstandard.decompress(data)


def to_payload(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return pack(sink.getvalue())


def from_payload(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(unpack(payload)).read_all().combine_chunks()


def texts_of(table: pa.Table, col: str) -> list[bytes]:
    """UTF-8 bytes of the texts; null counts as empty."""
    return [x or b"" for x in table.column(col).cast(pa.binary()).to_pylist()]


def ids_of(table: pa.Table, col: str) -> np.ndarray:
    """Document ids; a null id counts as larger than all others."""
    return table.column(col).cast(pa.int64()).fill_null(NO_ID).to_numpy()


def _batcher(text: str, size: int) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, held, held_bytes = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal seq, held, held_bytes
            table = pa.Table.from_batches(held)
            row = pa.RecordBatch.from_pydict({"batch": pa.array([(task << 24) + seq], pa.int64()), "n_docs": pa.array([len(table)], pa.int64()), "n_bytes": pa.array([held_bytes], pa.int64()), "payload": pa.array([to_payload(table)], pa.binary())})
            seq, held, held_bytes = seq + 1, [], 0
            return row

        for rows in it:
            lengths = pa.compute.binary_length(rows.column(rows.schema.get_field_index(text)).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
            start = 0
            for i, n in enumerate(lengths):
                if (i > start or held) and held_bytes + n > size:
                    if i > start:
                        held.append(rows.slice(start, i - start))
                    yield flush()
                    start = i
                held_bytes += int(n) + 64
            if start < len(lengths):
                held.append(rows.slice(start))
        if held:
            yield flush()

    return run


class Batches:
    """The documents of ``df`` as a written table of batches."""

    def __init__(self, df: DataFrame, text: str, ws: Workspace, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES):
        self.ws, self.spark = ws, df.sparkSession
        self.partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.mapInArrow(_batcher(text, batch_bytes), "batch long, n_docs long, n_bytes long, payload binary")
        self.table = ws.bucketed("batches", rows, "batch", self.partitions)
        total = self.table.agg(F.sum("n_bytes")).first()[0] or 0
        self.buckets = max(1, -(-total // bucket_bytes))

    def ask(self, fn: Callable[[int, pa.Table], Iterator[dict]], schema: str) -> DataFrame:
        """Rows that ``fn(batch, documents)`` yields as lists of columns."""
        types = _arrow_schema(self.spark, schema)

        def run(it):
            for rows in it:
                for batch, payload in zip(rows.column("batch").to_pylist(), rows.column("payload")):
                    for out in fn(batch, from_payload(payload.as_py())):
                        yield pa.RecordBatch.from_pydict(out, types)
            caches.trim()

        return self.table.select("batch", "payload").mapInArrow(run, schema)

    def give(self, answers: DataFrame, fn: Callable[[int, pa.Table, pa.Table], Iterator[dict]], schema: str) -> DataFrame:
        """``fn(batch, documents, answers of the batch)`` for every batch, with answers or without."""
        types = _arrow_schema(self.spark, schema)

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            out = [pa.RecordBatch.from_pydict(x, types) for payload in left.column("payload") for x in fn(key[0].as_py(), from_payload(payload.as_py()), right)]
            return pa.Table.from_batches(out, types)

        return self.table.select("batch", "payload").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)


def give_rows(rows: DataFrame, answers: DataFrame, fn: Callable[[int, bytes, pa.Table], Iterator[dict]], schema: str) -> DataFrame:
    """``fn(batch, blob, answers of the batch)`` for every row (batch, blob)."""
    types = _arrow_schema(rows.sparkSession, schema)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.RecordBatch.from_pydict(x, types) for blob in left.column("blob") for x in fn(key[0].as_py(), blob.as_py(), right)]
        return pa.Table.from_batches(out, types)

    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)


def _arrow_schema(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def answer(asked: DataFrame, fn: Callable[[pa.Table], Iterator[dict]], schema: str) -> DataFrame:
    """``fn(questions of a bucket)`` for every bucket."""
    types = _arrow_schema(asked.sparkSession, schema)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([pa.RecordBatch.from_pydict(x, types) for x in fn(table)], types)

    return asked.groupBy("bucket").applyInArrow(run, schema)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in their order) of all buckets that occur."""
    order = K.stable_order(buckets)
    s = buckets[order]
    cuts = np.flatnonzero(s[1:] != s[:-1]) + 1
    for part in np.split(order, cuts) if len(s) else []:
        yield int(buckets[part[0]]), part


# Which keys occur more than once: 32 bits of a key inside its bucket.  Two keys may share them;
# that adds a candidate now and then and loses none.


def ask_repeated(batch: int, keys: np.ndarray, buckets: int) -> Iterator[dict]:
    """Questions about the distinct keys of a batch."""
    keys = np.unique(keys)
    for b, part in by_bucket(bucket_of(keys, buckets)):
        yield {"bucket": [b], "batch": [batch], "blob": [pack((keys[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())]}


ASK_REPEATED = "bucket long, batch long, blob binary"
REPEATED = "batch long, bucket long, blob binary"


def _codes(hot: int) -> Callable:
    def run(table: pa.Table) -> Iterator[dict]:
        parts = [np.frombuffer(unpack(x), np.uint32) for x in table.column("blob").to_pylist()]
        every = np.concatenate(parts)
        values, counts = np.unique(every, return_counts=True)
        code = (counts > 1).astype(np.uint8) + (counts > hot)
        for batch, bucket, part in zip(table.column("batch").to_pylist(), table.column("bucket").to_pylist(), parts):
            yield {"batch": [batch], "bucket": [bucket], "blob": [pack(code[np.searchsorted(values, part)].tobytes())]}

    return run


def repeated(asked: DataFrame, hot: int) -> DataFrame:
    """For each batch's keys: 0 if no other batch has it, 1 if another has, 2 if more than ``hot`` batches have."""
    return answer(asked, _codes(hot), REPEATED)


def repeated_of(keys: np.ndarray, answers: pa.Table) -> np.ndarray:
    """The code of each key of a batch; a key that the batch itself repeats has 1 at least."""
    if not len(keys):
        return np.empty(0, np.uint8)
    values, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.argsort(answers.column("bucket").to_numpy())
    blobs = answers.column("blob").to_pylist()
    code = np.concatenate([np.frombuffer(unpack(blobs[i]), np.uint8) for i in order])
    return np.maximum(code, counts > 1)[inverse]
