"""Intermediate tables: written once to the folder that all executors share, which cuts a plan and survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """df, written to spark.checkpoint.dir (a temporary folder only for a local master without one) and read again; removed when the application ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        root = tempfile.mkdtemp(prefix="lexspark-")
        sc.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/lexspark-{what}-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on the session's Arrow batches hold size bytes at most and a row, or what it was set to if that is less: rows alone bound no memory."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
