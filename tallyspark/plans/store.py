"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once below spark.checkpoint.dir and read back: its lineage is cut, and lost executors lose none of it.

    Without that setting a session on one machine gets a temporary folder; on a cluster it is an error. What is written stays until the folder is cleared.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        root = f"file://{tempfile.mkdtemp(prefix='tallyspark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_there(df: DataFrame) -> bool:
    """Whether a stored table's folder hasn't been cleared."""
    files = df.inputFiles()
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]) if files else None
    return path is not None and path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(path)
