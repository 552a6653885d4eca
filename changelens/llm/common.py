"""What the operators of this package share: reading, scratch tables, splits."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that goes to Python, beside Spark's bound by rows: texts may be very long.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most BATCH_BYTES, unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864"):  # Spark's default
        spark.conf.set(name, str(BATCH_BYTES))


@lru_cache(maxsize=1)
def _trim():
    """The C library's function that returns freed memory; None where it has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def sweep() -> None:
    """The memory that this process has freed goes back to the system. Python workers run task after task and stage after
    stage, and neither the C library nor Arrow returns much by itself. Called where a task or a large group begins."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that driver and executors share: spark.checkpoint.dir. Where that is unset,
    in the warehouse, which they share as well; on a cluster without either, writing fails rather than leaving parts on
    single machines. It goes when the driver's Python ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    own = f"{folder.rstrip('/')}/changelens-{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_removed, spark, own)
    return own


_folders: set[str] = set()


def _removed(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:
        return  # the session has been stopped
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32(doc_id as text) mod divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
