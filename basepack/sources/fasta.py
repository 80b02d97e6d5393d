"""FASTA: lines with their record and base position, from byte ranges read in parallel.

A range is read with the lines that start in it.  What a range needs from those before it, the
record that is open and its bases so far, comes from a running sum over one small row a range, on
the driver; so a chromosome of any length is read by many tasks.  A line is a row: a file without
line breaks in its sequences gives rows as long as its records.

A path is a file, or a folder whose files, in the order of their names, are one FASTA file in parts;
a line ends with its part, a record does not.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import ship
from . import files

RANGE_BYTES = 64 << 20
#: Most bytes and lines of a batch of lines.
BATCH_BYTES, BATCH_LINES = 4 << 20, 20_000
CUTS = "range long, file string, base long, start long, end long"
LINES = "name string, ordinal long, position long, line string"


def record_name(header: str) -> str:
    """The first word behind ``>``; names that cannot be those of an array are refused."""
    parts = header[1:].split()
    name = parts[0] if parts else ""
    if not name or name in (".", "..") or "/" in name:
        raise ValueError(f"invalid FASTA record name: {name!r}")
    return name


def _lines(uri: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(offset, stripped text) of the lines that start in [start, end)."""
    fs, path = files.opened(uri)
    with io.BufferedReader(fs.open_input_file(path), 1 << 20) as f:
        at = start
        if start:
            f.seek(start - 1)
            at = start - 1 + len(f.readline())  # the rest of a line of the range before
        f.seek(at)
        while at < end:
            raw = f.readline()
            if not raw:
                return
            text = raw.decode("ascii").strip()
            if text:
                yield at, text
            at += len(raw)


def parts(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a FASTA file, or of the parts in a folder; hidden ones are none."""
    fs, at = files.opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    found = sorted((i.base_name, i.size) for i in fs.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.File and i.base_name[0] not in "._")
    return [(f"{path.rstrip('/')}/{name}", size) for name, size in found]


def _dealt(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of ranges, dealt over tasks by their order: some tasks a core, and more where a task had more than RANGE_BYTES."""
    most = sum(r[4] - r[3] for r in rows) // RANGE_BYTES + 1
    tasks = max(1, min(len(rows), max(most, 4 * spark.sparkContext.defaultParallelism)))
    return spark.createDataFrame(rows, schema).repartitionByRange(tasks, "range")


def ranges(path: str, size: int = RANGE_BYTES) -> list[tuple]:
    """(range, file, base, start, end) that cut the files; ``base``: bytes of the parts before."""
    out, base = [], 0
    for file, n in parts(path):
        out += [(len(out) + k, file, base, at, min(at + size, n)) for k, at in enumerate(range(0, n, size))]
        base += n
    return out


def _carried(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Ranges with the record that is open where they begin, and its bases so far."""
    ship(spark)
    cuts = ranges(path, size)
    heads = {r.range: r for r in _summaries(_dealt(spark, cuts, CUTS)).collect()}  # a small row a range
    rows, opened, bases = [], None, 0
    for cut in cuts:
        rows.append((*cut, opened, bases))
        head = heads[cut[0]]
        opened, bases = (head.last_header, head.tail) if head.last_header else (opened, bases + head.tail)
    return _dealt(spark, rows, f"{CUTS}, open struct<at:long,name:string>, bases long")


def read_fasta(spark: SparkSession, path: str, permissive: bool = False, size: int = RANGE_BYTES) -> DataFrame:
    """(name, ordinal, position, line): sequence lines, ``ordinal`` being the offset of the record's header.

    Strict: data before the first header is an error.  Permissive: it is left out.
    A record without bases has no line; ``records`` has it.
    """

    def emit(it):
        for batch in it:
            for row in batch.to_pylist():
                name, ordinal, position, out, held = None, -1, row["bases"], [], 0
                if row["open"] is not None:
                    name, ordinal = row["open"]["name"], row["open"]["at"]
                for at, text in _lines(row["file"], row["start"], row["end"]):
                    if text.startswith(">"):
                        name, ordinal, position = record_name(text), row["base"] + at, 0
                        continue
                    if name is None:
                        if permissive:
                            continue
                        raise ValueError("sequence data before the first FASTA header")
                    out.append((name, ordinal, position, text))
                    position += len(text)
                    held += len(text)
                    if held >= BATCH_BYTES or len(out) >= BATCH_LINES:
                        yield _batch(out)
                        out, held = [], 0
                yield _batch(out)

    return _carried(spark, path, size).mapInArrow(emit, LINES)


def _batch(rows: list) -> pa.RecordBatch:
    n, o, p, t = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_pydict({"name": pa.array(n, pa.string()), "ordinal": pa.array(o, pa.int64()), "position": pa.array(p, pa.int64()), "line": pa.array(t, pa.string())})


def _summaries(cuts: DataFrame) -> DataFrame:
    """For each range: its last header, and the bases behind it (of the whole range if it has none)."""
    kind = pa.struct([("at", pa.int64()), ("name", pa.string())])

    def run(it):
        for batch in it:
            for row in batch.to_pylist():
                last, tail = None, 0
                for at, text in _lines(row["file"], row["start"], row["end"]):
                    if text.startswith(">"):
                        last, tail = {"at": row["base"] + at, "name": record_name(text)}, 0
                    else:
                        tail += len(text)
                yield pa.RecordBatch.from_pydict({"range": [row["range"]], "last_header": pa.array([last], kind), "tail": pa.array([tail], pa.int64())})

    return cuts.mapInArrow(run, "range long, last_header struct<at:long,name:string>, tail long")


def records(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """(name, ordinal, logical_length) of a strict FASTA file; duplicates and files without records are errors."""

    def count(it):
        for batch in it:
            for row in batch.to_pylist():
                open_ = row["open"] or {"name": None, "at": -1}
                names, ordinals, bases = [open_["name"]], [open_["at"]], [0]
                for at, text in _lines(row["file"], row["start"], row["end"]):
                    if text.startswith(">"):
                        names.append(record_name(text))
                        ordinals.append(row["base"] + at)
                        bases.append(0)
                    elif names[-1] is None:
                        raise ValueError("sequence data before the first FASTA header")
                    else:
                        bases[-1] += len(text)
                skip = int(names[0] is None)
                yield pa.RecordBatch.from_pydict({"name": pa.array(names[skip:], pa.string()), "ordinal": pa.array(ordinals[skip:], pa.int64()), "n": pa.array(bases[skip:], pa.int64())})

    out = _carried(spark, path, size).mapInArrow(count, "name string, ordinal long, n long").groupBy("name", "ordinal").agg(F.sum("n").alias("logical_length"))
    names = out.groupBy("name").count()
    many, twice = names.agg(F.count("*"), F.array_sort(F.collect_set(F.when(F.col("count") > 1, F.col("name"))))).first()
    if twice:
        raise ValueError(f"duplicate FASTA records: {', '.join(twice)}")
    if not many:
        raise ValueError("FASTA file has no records")
    return out


def with_prefix(found: DataFrame, prefix: str = "chr") -> DataFrame:
    """Records whose names begin with ``prefix``."""
    return found.where(F.col("name").startswith(prefix))


def wanted(found: DataFrame, names: DataFrame) -> DataFrame:
    """The records that ``names`` (name) asks for."""
    return found.join(names.select("name").distinct(), "name", "left_semi")


def missing(found: DataFrame, names: DataFrame) -> DataFrame:
    """The names asked for that no record has."""
    return names.select("name").distinct().join(found.select("name"), "name", "left_anti")


def read_fai(spark: SparkSession, fasta: str) -> DataFrame | None:
    """(name, length) from the index beside a FASTA file, or None; rows of fewer than two fields are left out."""
    if not files.exists(f"{fasta}.fai"):
        return None
    rows = spark.read.text(f"{fasta}.fai").select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("ordinal"))
    return rows.where(F.size("f") >= 2).select(F.col("f")[0].alias("name"), "ordinal", F.col("f")[1].cast("long").alias("logical_length"))


def select_chromosomes(spark: SparkSession, fasta: str, chosen: list[str]) -> DataFrame:
    """Records by name, from the index if there is one; ``["all"]`` is all; missing names are an error."""
    found = read_fai(spark, fasta)
    found = records(spark, fasta) if found is None else found
    if chosen == ["all"]:
        return found
    names = spark.createDataFrame([(w,) for w in chosen], "name string").distinct()
    lost = missing(found, names).agg(F.array_sort(F.collect_set("name"))).first()[0]
    if lost:
        raise ValueError(f"missing chromosomes: {', '.join(lost)}")
    return wanted(found, names)
