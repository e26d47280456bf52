"""Shared helpers: shared-folder tables, stable ids, Arrow batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one step of a vectorised Python loop handles at a time.
SLICE_BYTES = 1 << 19


# Python workers live on from stage to stage. Blocks of 256 KB and more are mapped one by
# one, so an array's memory goes back to the system when it is freed (glibc's mallopt with
# M_MMAP_THRESHOLD and M_TRIM_THRESHOLD; other systems do without).
with contextlib.suppress(OSError, AttributeError):
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 1 << 18)
    _libc.mallopt(-1, 1 << 20)


def given_back() -> None:
    """Return memory that is free to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, NameError):
        _libc.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local runs; on a cluster it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        if java.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            java = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = java.get()
    return path.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete saved() tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(df: DataFrame, ddl: str) -> StructType:
    """df's schema with more fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows that hold about `limit` bytes of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if batch.num_rows > begin:
        yield batch.slice(begin)
    given_back()
