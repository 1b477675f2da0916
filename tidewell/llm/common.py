"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the inside of a regular-expression class, and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = f"[^{SPACE_CLASS}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """The words of a text in order; none for a null."""
    gaps = F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+")
    return F.filter(gaps, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Where the session names none, a local session gets a temporary folder of its own; a cluster gets an
    error, as a folder on one machine would lose data there.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="scratch-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


class Written:
    """A DataFrame that was written to the shared folder: its lineage ends there."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; nothing may read them later."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each batch as Python lists."""
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans that run inside send Python workers so many rows at once, so that long texts fit in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def driver_bytes(spark: SparkSession, path: str, most: int = 64 << 20):
    """A broadcast of a vocabulary file's bytes, of checked size."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} has over {most} bytes, too many to send to every executor")
    return spark.sparkContext.broadcast(data)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no live DataFrame reads, now rather than at the next collection."""
    gc.collect()
    spark._jvm.System.gc()


def sent_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for a broadcast join if it has at most so many rows; else a shuffle joins it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
