"""What the training-data operators share: the shared folder, written tables, packed exchanges."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word contracts: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch of rows on its way to a Python worker; one row may be larger.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a folder of its own."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Holds batches sent to Python under BATCH_BYTES: a row may be a block of documents, and a batch is there in the JVM and in Python at once."""
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage and outlives lost executors. by: a column with a folder for each value."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


Batches = Iterator[pa.RecordBatch]


#: What a worker keeps between tasks of one kind, by name: functions that let it go.
_KEPT: dict[str, Callable[[], None]] = {}


def kept(name: str, forget: Callable[[], None]) -> None:
    """Tables that tasks of one kind share in a worker; every task of another kind lets them go."""
    _KEPT[name] = forget


def give_back(own: str | None = None) -> None:
    """Lets go of all that is kept but the task's own, and gives free memory back to the system."""
    for name, forget in _KEPT.items():
        if name != own:
            forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        return


def freed(run: Callable[[Batches], Batches], own: str | None = None) -> Callable[[Batches], Batches]:
    """A function for mapInArrow whose worker gives memory back when its task begins and ends: Spark keeps workers for the next stage. own: the tables that its tasks share."""

    def wrapped(batches: Batches) -> Batches:
        give_back(own)
        try:
            yield from run(batches)
        finally:
            give_back(own)

    return wrapped


def partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the deployment sizes them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str | Column) -> Column:
    """Bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def word_count(text: str | Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")
