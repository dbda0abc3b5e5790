"""What the text operators share: shared scratch tables, batch sizes, normal forms of text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts vary from one word to megabytes, so that Arrow batches are kept to few rows and bounded bytes.
BATCH_ROWS, BATCH_BYTES = 1024, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that the session sends to Python workers."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which every executor sees.

    Where that is unset a session on one machine gets a temporary folder; on a cluster it is an error, as executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(items: list, weights: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``items`` whose weights sum to ``most`` at most, or single items."""
    start = total = 0
    for i, w in enumerate(weights):
        if i > start and total + w > most:
            yield start, i
            start, total = i, 0
        total += w
    if start < len(items):
        yield start, len(items)


@cache
def _trim():
    """The C library's call that gives free pages back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Gives memory that is free in this worker back to the system: workers live through many tasks, and an allocator keeps what it has had at most."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text. What the batch before has left free is given back first."""
    give_back()
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def bucket(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts
