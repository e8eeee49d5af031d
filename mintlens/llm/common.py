"""What the corpus operators share: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch: with whole texts, Spark's 10,000 are 30 MB and more for each task in the JVM and in Python.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows from now on, unless the session has another number than Spark's own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where none is set and Spark is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not (folder or context.getCheckpointDir() or re.fullmatch(r"local(\[.*\])?", context.master)):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="mintlens-"))
    return folder or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _delete(spark: SparkSession, path: str, now: bool) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(jpath, True) if now else files.deleteOnExit(jpath)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Unlike a checkpoint, the table tells Catalyst its true size, so a later join broadcasts it only below
    ``spark.sql.autoBroadcastJoinThreshold`` and is a sort-merge join above.  Deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete(spark, path, now=False)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """``stored`` for the length of a block: its tables are deleted when it ends, so nothing read later may rest on them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.tables = spark, f"{shared_dir(spark)}/work-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        _delete(self.spark, self.path, now=True)


#: Rows of ids and hashes that a broadcast may hold: some 30 MB.
BROADCAST_ROWS = 1 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table of a few numbers a row, marked for broadcast if it has ``rows`` rows at most; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def slices(batch: pa.RecordBatch, column: int, group_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of about ``group_bytes`` of text in ``column``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // group_bytes
    cuts = [*np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), batch.num_rows] if batch.num_rows else []
    for lo, hi in pairwise(cuts):
        yield batch.slice(lo, hi - lo)


def same(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Null-safe equality of the paired columns, as a join condition."""
    cond = F.lit(True)
    for a, b in pairs.items():
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it while the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
