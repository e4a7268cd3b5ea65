"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows on its way to a Python worker; one row may be larger.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on a local master a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Holds batches sent to Python under BATCH_BYTES while a table is written: a row may be a block of others."""
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def giving_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker gives free memory back to the system, for Spark keeps it for the next stage."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library than glibc
            pass


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage and outlives lost executors. by: a column with a folder for each value."""
    path = new_dir(df.sparkSession, name)
    with small_batches(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> str:
    """Tells one state of the files that a DataFrame reads from another: a hash of their paths, lengths and times of change, made where the files are listed."""
    context = df.sparkSession.sparkContext
    sha = hashlib.sha256()
    for file in sorted(df.inputFiles()):
        path = context._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(path)
        sha.update(f"{file}\n{status.getLen()}\n{status.getModificationTime()}\n".encode())
    return sha.hexdigest()[:32]


def kept(spark: SparkSession, name: str, make: Callable[[str], object]) -> str:
    """The folder of that name in the shared folder; where it is not there, make fills a folder that then gets the name. Whoever comes second uses what the first one made."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/docloom/{name}")
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(target):
        folder = new_dir(spark, "making")
        make(folder)
        made = context._jvm.org.apache.hadoop.fs.Path(folder)
        if files.exists(target) or not files.rename(made, target):
            files.delete(made, True)
    return target.toString()
