"""Tables that cut lineage, in the folder which all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; an own temporary folder only where it is unset and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "basepack-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_shipped: set[str] = set()


#: Most bytes of an Arrow batch on its way to Python, where the session leaves Spark's default.
ARROW_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a Spark application, and bounds the session's Arrow batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in ("67108864b", "64m"):
        spark.conf.set(name, str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent
    d = tempfile.mkdtemp(prefix="basepack-")  # served to executors until the driver ends
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    path = Path(d) / "basepack.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))


#: Database of working tables that are bucketed; those of drivers that were killed can be dropped with it.
DATABASE = "basepack_work"


class Workspace:
    """Written tables of one operator run.

    Each table is complete before it is read, so that a lost executor costs a task and not the
    lineage above.  ``close`` deletes them; results that still read them must be written before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship(spark)
        self.name = f"basepack_{name}_{uuid.uuid4().hex[:12]}"
        self.root = f"{shared_dir(spark)}/{self.name}"
        self._tables: list[str] = []
        atexit.register(self.close)

    def write(self, name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        path, writer = f"{self.root}/{name}", df.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, name: str, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """Writes a table that joins and cogroups on ``key`` read without a shuffle."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE} LOCATION '{shared_dir(self.spark)}/{DATABASE}'")
        table = f"{DATABASE}.{self.name}_{name}"
        self._tables.append(table)
        df.write.bucketBy(buckets, key).option("path", f"{self.root}/{name}").format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def close(self) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None or sc._jsc.sc().isStopped():
            if urlparse(self.root).scheme in ("", "file"):
                shutil.rmtree(urlparse(self.root).path, ignore_errors=True)
            return
        for t in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self._tables.clear()
        path = sc._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
